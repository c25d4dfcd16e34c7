"""Personal data: exact base patterns, and spans found by bootstrapped lexical contexts.

Base spans are the seeds. What stands before a seed induces lexical patterns; patterns and the identifiers they precede
form a weighted graph over the whole corpus, on which Spark scores both sides in turn. Patterns of high confidence then
admit identifiers that the base patterns don't know, as long as they look like their kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.llm.arrowtext import parts
from cashlens.llm.shelf import Shelf

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)  # tokens with digits or signs of an address that are of no kind: what makes a pattern unspecific

ROUNDS = 3
SUPPORT = 4  # distinct trusted identifiers that a pattern must precede
CONFIDENCE = 0.8  # of a pattern, from which on it admits identifiers
PRIOR = 1.0  # fillers that a pattern is assumed to have besides those seen, none of its kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit after a digit can't begin a match that its run's first digit doesn't: skipping it keeps long runs linear.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser shapes, which count only after a pattern of high confidence.
_LOOSE = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,8}", re.I)),
    (1, re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9-])[0-9]{4}[ -]?[0-9]{4,6}[ -]?[0-9]{4,5}(?![0-9-])")),
    (3, re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|0?[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])")),
)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_LEFT = 80  # characters before a span in which its context words are looked for
_EDGE = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a name reaches back from its @ as far as its characters go, not into the match before."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four kinds, in code points, by the base patterns."""
    out: list[list[tuple[int, int]]] = [_emails(text), [], [], []]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out[2].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out[3].append(m.span())
    return out


def loose_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of looser shapes that touch no span in `taken`."""
    out: list[tuple[int, int, int]] = []
    used = list(taken)
    for kind, pattern in _LOOSE:
        if kind == 0 and "at" not in text.lower() or kind == 1 and ":" not in text:
            continue
        for m in pattern.finditer(text):
            digits = "".join(c for c in m[0] if "0" <= c <= "9")
            if kind == 2 and not (13 <= len(digits) <= 15 and luhn(digits)) or kind == 3 and not 8 <= len(digits) <= 15:
                continue
            if all(m.end() <= a or b <= m.start() for a, b in used):
                used.append(m.span())
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: s[1])


def contexts(text: str, start: int) -> list[str]:
    """Lexical patterns for what begins at `start`: the word before it and the two words before it, without digits."""
    words = text[max(0, start - _LEFT) : start].lower().split()
    words = words[1:] if start > _LEFT and len(words) > 2 else words
    words = [_EDGE.sub("", w) for w in words[-2:]]
    glued = start > 0 and not text[start - 1].isspace()
    return [("~" if glued else "") + " ".join(words[-k:]) for k in (1, 2) if len(words) >= k]


def normal(kind: int, value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9") if kind in (2, 3) else value.lower()


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_FILL = pa.struct(
    [
        ("kind", pa.int32()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("seed", pa.bool_()),
        ("instance", pa.string()),
        ("patterns", pa.list_(pa.string())),
    ]
)
FOUND = (
    "id long, of binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
    "base array<struct<kind:int,start:bigint,end:bigint>>, "
    "fills array<struct<kind:int,start:bigint,end:bigint,seed:boolean,instance:string,patterns:array<string>>>"
)


def _scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    base = [(k, a, b) for k, spans in enumerate(base_spans(text)) for a, b in spans]
    taken = [(a, b) for _, a, b in base]
    fills = [(k, a, b, True) for k, a, b in base]
    if _DIGIT.search(text) or "(at)" in text.lower() or "[at]" in text.lower():
        loose = loose_spans(text, taken)
        fills += [(*s, False) for s in loose]
        covered = sorted(taken + [(a, b) for _, a, b in loose])
        at = 0
        for m in _TOKEN.finditer(text):
            while at < len(covered) and covered[at][1] <= m.start():
                at += 1
            if at == len(covered) or covered[at][0] >= m.end():
                fills.append((OTHER, *m.span(), False))
    out = []
    for kind, a, b, seed in fills:
        value = normal(kind, text[a:b])
        out.append({"kind": kind, "start": a, "end": b, "seed": seed, "instance": value, "patterns": contexts(text, a)})
    return base, out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, "text"):
        rows = [_scan_text(text or "") for text in part.column("text").to_pylist()]
        count = lambda k: pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("id"),
                part.column("of"),
                *[count(k) for k in range(len(KINDS))],
                pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in base] for base, _ in rows], pa.list_(_SPAN)),
                pa.array([fills for _, fills in rows], pa.list_(_FILL)),
            ],
            ["id", "of", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "fills"],
        )


def pattern_confidence(fills: DataFrame, shelf: Shelf, rounds: int = ROUNDS) -> DataFrame:
    """(kind, pattern, confidence, support) from fills (kind, seed, instance, patterns): the scored graph's good patterns.

    An identifier's score is 1 if it is a seed, else the best confidence among the patterns it follows; a pattern's
    confidence is the summed score of its identifiers of a kind over all its fillers, of whatever kind, without those of
    its kind that have no score yet: they speak neither for it nor against it. Copies of a text repeat both, so
    identifiers of a pattern count once each. Every step is an aggregation with map-side combining or a join of written
    tables.
    """
    edges = fills.select("kind", "seed", "instance", F.explode("patterns").alias("pattern"))
    edges = shelf.put(edges.groupBy("kind", "instance", "pattern").agg(F.max("seed").alias("seed")))
    known = edges.filter(f"kind < {OTHER}")
    fillers = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("any"))
    fillers = shelf.put(fillers.filter("any").select("pattern", "n"))
    scores = known.filter("seed").select("kind", "instance", F.lit(1.0).alias("score")).distinct()
    seeds = scores = shelf.put(scores)
    good = None
    for _ in range(rounds):
        scored = known.join(scores, ["kind", "instance"], "left").groupBy("kind", "pattern")
        scored = scored.agg(
            F.sum("score").alias("mass"),
            F.sum((F.col("score") >= CONFIDENCE).cast("int")).alias("support"),
            F.sum(F.col("score").isNull().cast("int")).alias("undecided"),
        )
        # Rounded, so that the order in which scores are summed doesn't decide at the threshold.
        share = F.col("mass") / (F.col("n") - F.col("undecided") + PRIOR)
        joined = scored.filter("mass IS NOT NULL").join(fillers, "pattern").withColumn("confidence", F.round(share, 9))
        good = joined.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        good = shelf.put(good.select("kind", "pattern", "confidence", "support"))
        found = known.filter("NOT seed").join(good, ["kind", "pattern"]).groupBy("kind", "instance")
        found = found.agg(F.max("confidence").alias("score")).join(seeds, ["kind", "instance"], "left_anti")
        scores = shelf.put(seeds.unionByName(found.select("kind", "instance", "score")))
    return good


def _listing(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    part = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), part), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, n_added, spans (all).

    Positions are code points, end exclusive; lists are ordered by kind as in KINDS, then start. Null and empty texts
    have no spans. Added spans never touch base spans. Rows with equal id and text get equal spans; ids may be null or
    repeat. An empty table gives no rows; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, "pii")
    text = F.col(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.md5(text)).alias("of"), text.alias("text"))
    found = shelf.put(source.mapInArrow(_scan, FOUND))
    fills = found.select("of", F.explode("fills").alias("fill")).select("of", "fill.*")
    good = pattern_confidence(fills.select("kind", "seed", "instance", "patterns"), shelf)
    loose = fills.filter(f"NOT seed AND kind < {OTHER}").select("of", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    span = F.struct("kind", "start", "end")
    added = loose.join(good.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
    added = shelf.put(added.groupBy("of").agg(F.collect_set(span).alias("added")))
    shelf.keep(found, added)
    joined = found.drop("fills").join(added, "of", "left")
    both = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return joined.select(
        F.col("id").alias(id_col),
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        "base_sha256",
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
        _listing(both).alias("spans"),
    )
