"""Dimensions with a fixed, small row count: lenders, industries, description rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cashlens.functions import fixed

# Lender -> name variants, in matching order (first match wins).
PREMIUM_LENDERS = {
    "MERCHANT GROWTH": ["MERCHANT GROWTH", "MERCHPAD", "MERCH PAD"],
    "GREENBOX": ["GREENBOX", "GREEN BOX", "GREENBOX CAPITAL"],
    "VAULT": ["VAULT", "VAULT FINANCIAL"],
    "DRIVEN": ["DRIVEN", "DRIVEN CAPITAL"],
    "JOURNEY": ["JOURNEY", "JOURNEY CAPITAL", "JOURNEY FUNDING", "ONDECK"],
    "ICAPITAL": ["ICAPITAL", "I CAPITAL", "IPAPITAL"],
}
STANDARD_LENDERS = {
    "CANACAP": ["CANACAP", "CANA CAP", "CANA CAPITAL", "CANACAPITAL"],
    "2M7": ["2M7", "2M7 FINANCIAL", "URAL", "URAL CAPITAL"],
    "BIZFUND": ["BIZFUND", "BIZ FUND", "BIZ-FUND"],
    "XUPER": ["XUPER", "XUPER FUNDING", "XUPER CAPITAL"],
    "NEWCO": ["NEWCO", "NEWCO CAPITAL"],
    "SHEAVES": ["SHEAVES", "SHEAVES CAPITAL"],
    "CMCA": ["CMCA", "C.M.C.A.", "CANADIAN MERCHANT"],
    "B2B": ["B2B", "B2B CAPITAL", "B2B FUNDING"],
    "FORWARD FUNDING": ["FORWARD FUNDING", "FORWARDFUNDING"],
    "KM CAPITAL": ["2313833 ONTARIO", "2313833 ONTARIO INC", "KM CAPITAL"],
    "EFSA": ["EFSA", "EFSA CAPITAL"],
    "ROOK BRISTOL": ["ROOK BRISTOL"],
    "ELECT CAPITAL": ["ELECT CAPITAL"],
    "SHARP SHOOTER": ["SHARP SHOOTER FUNDING", "SSF"],
    "MFUND": ["MFUND"],
    "9341-8812 QUEBEC": ["9341-8812 QUE", "9341-8812 QUEBEC INC"],
    "NORTH FUNDING": ["NORTH FUNDING"],
    "BUSINESS CREDIT CAPITAL": ["BUSINESS CR", "BCC", "BUSINESS CREDIT CAPITAL"],
    "FLEX CAPITAL": ["FLEXCAPITALGROUP", "FLEX CAPITAL"],
    "ONTAP": ["ONTAP CAPITAL"],
    "CLARA": ["CLARA CAPITAL"],
    "FUNDFI": ["FUNDFI"],
    "ADVENTEX": ["ADVANTEX", "ADVANTEX MARKETING", "ADVANTEX DINING"],
    "CAPITAL ADVANCE": ["CAPITAL ADVANCE"],
    "SIMPLY": ["SIMPLY"],
    "CLARIO": ["CLARIO"],
    "BIZCAP": ["BIZCAP"],
    "KEEP BUS": ["KEEP BUS", "KEEP BUS/ENT"],
    "1048279 ONT": ["1048279 ONT", "1048279 ONT RLS/LOY"],
    "TOTAL CREDIT": ["TOTAL CREDIT"],
    "PEOPLES TRUST": ["PEOPLES TRUST"],
    "ACURA FINANCE": ["ACURA FINANCE"],
}

# Fixed values: (industry, points, seasonality points), in listed order.
INDUSTRIES = [
    ("0191 - General Farms, Primarily Crop", 4, 1),
    ("0212 - Beef Cattle, Except Feedlots", 4, 3),
    ("1521 - General Contractors—Single-Family Houses", 4, 2),
    ("1522 - General Contractors—Residential Buildings, Other", 4, 2),
    ("1542 - General Contractors—Nonresidential Buildings", 5, 3),
    ("1611 - Highway and Street Construction", 5, 1),
    ("1711 - Plumbing, Heating & Air-Conditioning", 7, 3),
    ("1721 - Painting and Paper Hanging", 4, 1),
    ("1731 - Electrical Work", 7, 3),
    ("1741 - Masonry, Stonework, Tile Setting & Plastering", 5, 1),
    ("1751 - Carpentry Work", 5, 2),
    ("1761 - Roofing, Siding & Sheet Metal Work", 3, 1),
    ("1771 - Concrete Work", 4, 1),
    ("1794 - Excavation Work", 4, 1),
    ("1799 - Special Trade Contractors, NEC", 5, 3),
    ("2011 - Meat Packing Plants", 5, 5),
    ("2051 - Bread and Other Bakery Products", 6, 6),
    ("2431 - Millwork", 5, 3),
    ("2511 - Wood Household Furniture", 5, 3),
    ("2752 - Commercial Printing, Lithographic", 5, 5),
    ("3441 - Fabricated Structural Metal", 5, 3),
    ("4212 - Local Trucking Without Storage", 4, 3),
    ("4213 - Trucking, Except Local", 4, 3),
    ("4215 - Courier Services, Except by Air", 5, 5),
    ("5013 - Motor Vehicle Supplies & New Parts—Wholesale", 6, 6),
    ("5031 - Lumber, Plywood, Millwork & Wood Panels—Wholesale", 5, 3),
    ("5045 - Computers & Peripheral Equipment and Software—Wholesale", 6, 6),
    ("5211 - Lumber & Other Building Materials Dealers", 6, 3),
    ("5251 - Hardware Stores", 7, 5),
    ("5411 - Grocery Stores", 7, 6),
    ("5461 - Retail Bakeries", 6, 5),
    ("5511 - Motor Vehicle Dealers (New and Used)", 4, 3),
    ("5521 - Motor Vehicle Dealers (Used Only)", 3, 3),
    ("5531 - Auto and Home Supply Stores", 6, 6),
    ("5541 - Gasoline Service Stations", 6, 6),
    ("5611 - Men's and Boys' Clothing Stores", 5, 2),
    ("5621 - Women's Clothing Stores", 5, 2),
    ("5661 - Shoe Stores", 5, 3),
    ("5712 - Furniture Stores", 4, 3),
    ("5731 - Radio, Television & Consumer Electronics Stores", 4, 3),
    ("5812 - Eating Places / Restaurants", 4, 2),
    ("5813 - Drinking Places / Bars", 2, 1),
    ("5912 - Drug Stores & Proprietary Stores", 7, 6),
    ("5921 - Liquor Stores", 5, 3),
    ("5999 - Miscellaneous Retail Stores, NEC", 4, 3),
    ("6512 - Operators of Nonresidential Buildings", 6, 6),
    ("6513 - Operators of Apartment Buildings", 7, 6),
    ("7011 - Hotels & Motels", 4, 1),
    ("7215 - Coin-Operated Laundries & Drycleaning", 7, 6),
    ("7231 - Beauty Shops", 6, 3),
    ("7241 - Barber Shops", 6, 5),
    ("7311 - Advertising Agencies", 6, 5),
    ("7349 - Building Cleaning & Maintenance Services, NEC", 7, 6),
    ("7371 - Computer Programming Services", 7, 6),
    ("7372 - Prepackaged Software", 7, 6),
    ("7373 - Computer Integrated Systems Design", 7, 6),
    ("7538 - General Automotive Repair Shops", 7, 5),
    ("7542 - Carwashes", 6, 2),
    ("7997 - Membership Sports & Recreation Clubs", 4, 2),
    ("7999 - Amusement & Recreation Services, NEC", 3, 1),
    ("8011 - Offices & Clinics of Doctors of Medicine", 8, 6),
    ("8021 - Offices & Clinics of Dentists", 8, 6),
    ("8041 - Offices & Clinics of Chiropractors", 7, 5),
    ("8042 - Offices & Clinics of Optometrists", 7, 5),
    ("8049 - Offices & Clinics of Health Practitioners, NEC", 7, 5),
    ("8082 - Home Health Care Services", 7, 6),
    ("8111 - Legal Services", 8, 6),
    ("8721 - Accounting, Auditing & Bookkeeping Services", 8, 3),
    ("8742 - Management Consulting Services", 7, 5),
    ("8999 - Services, NEC", 4, 3),
]

LENDER_TIERS = [("Premium", PREMIUM_LENDERS), ("Standard", STANDARD_LENDERS)]


def lender_list() -> list[tuple[str, str, list[str]]]:
    """(lender, tier, variants) in matching order."""
    return [(name, tier, names) for tier, group in LENDER_TIERS for name, names in group.items()]


def _small_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """Local relation with a leading 1-based rank, so that Spark knows its (fixed) size."""
    ranked = [(rank, *row) for rank, row in enumerate(rows, 1)]
    columns = [pa.array(values, field.type) for values, field in zip(zip(*ranked), schema)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema))


def lenders(spark: SparkSession) -> DataFrame:
    schema = pa.schema(
        [("rank", pa.int32()), ("variant", pa.string()), ("lender", pa.string()), ("tier", pa.string())]
    )
    rows = [(v, name, tier) for name, tier, variants in lender_list() for v in variants]
    return _small_table(spark, schema, rows)


def industries(spark: SparkSession) -> DataFrame:
    schema = pa.schema(
        [
            ("rank", pa.int32()),
            ("industry", pa.string()),
            ("points", pa.int32()),
            ("seasonality", pa.int32()),
        ]
    )
    return _small_table(spark, schema, INDUSTRIES)


def rules(spark: SparkSession) -> DataFrame:
    groups = [
        ("internal_transfer", fixed.INTERNAL_TRANSFER_PATTERNS),
        ("government", fixed.GOVERNMENT_PATTERNS),
        ("nsf", fixed.NSF_PATTERNS),
        ("pos", [fixed.POS_PATTERN]),
    ]
    schema = pa.schema([("rank", pa.int32()), ("rule_group", pa.string()), ("pattern", pa.string())])
    return _small_table(spark, schema, [(g, p) for g, patterns in groups for p in patterns])
