import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cashlens.llm import pii
from tests_llm_util import documents

# The contract's patterns as they are written there.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def ours(text):
    return [(pii.KINDS[k], a, b) for k, spans in enumerate(pii.base_spans(text)) for a, b in spans]


CARD = "4539 1488 0343 6467"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "B.", "@", "-", "+", ".", "1", "25", "256", "0", " ", "(", ")", "ä", CARD, "a@b.c", "+1 555 0100 22", "1.2.3.4", "٣"]), max_size=14))
def test_base_spans_equal_the_patterns(pieces):
    text = "".join(pieces)
    assert ours(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 300_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000):
        ours(text)
    assert ours("x" * 200_000 + " a@b.cd") == [("email", 200_001, 200_007)]


def test_contexts_discover_and_clean_text_stays(spark):
    rows = [(k, f"Some words {k}. Reach desk phone: +1 (555) 010-{1000 + k} today") for k in range(8)]
    rows += [(20, "Reach desk phone: (555) 010-2000 today"), (21, "part number (555) 010-2001 in stock"), (22, "sold 3 of 4")]
    rows += [(30, None), (31, ""), (32, f"ip 10.0.0.1 card {CARD} 1.2.3.999"), (32, f"ip 10.0.0.1 card {CARD} 1.2.3.999"), (None, "a@b.cd")]
    rows += [(33, "y" * 300_000 + " a@b.cd")]
    found = pii.personal_data(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    texts = dict(rows)
    for r in found:
        text = texts[r.doc_id] or ""
        base = [f"{k}:{a}:{b}" for k, a, b in plain(text)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]
        added = ["phone:18:32"] if r.doc_id == 20 else []
        assert r.spans == ",".join(base + added) and r.n_added == len(added)
    assert pii.personal_data(documents(spark, rows).limit(0)).count() == 0


def test_contexts_with_many_unseen_identifiers(spark):
    seen = lambda first, n, words, after="": [(first + k, f"{words} +1 (555) 010-{first + k}{after}") for k in range(n)]
    unseen = lambda first, n, words: [(first + k, f"{words} (555) 010-{first + k}") for k in range(n)]
    rows = seen(1000, 8, "please dial") + unseen(1100, 8, "please dial")
    rows += seen(1200, 4, "reach hotline") + unseen(1300, 150, "reach hotline")
    # Unspecific: other tokens, or another kind, between the phones; and too few trusted ones.
    rows += seen(2000, 8, "we sold") + unseen(2100, 8, "we sold") + [(2200 + k, f"we sold {k} pieces") for k in range(3)]
    rows += seen(3000, 8, "his entry") + unseen(3100, 8, "his entry") + [(3200 + k, f"his entry 10.0.0.{k}") for k in range(3)]
    rows += seen(4000, 3, "maybe at") + unseen(4100, 8, "maybe at")
    found = {r.doc_id: r.n_added for r in pii.personal_data(documents(spark, rows)).collect()}
    assert {i for i, n in found.items() if n} == {*range(1100, 1108), *range(1300, 1450)}
    assert set(found.values()) == {0, 1}
