"""Personal data against a brute-force version, and the odd cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import regex

from runloom.llm import pii
from runloom.llm.queries import QUERIES

# The patterns as stated, before they were made safe from backtracking.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), k, m.end(), m[0]))
    return sorted(found)


def sanitised(texts):
    """Of each text its base and term spans."""
    base = [base_spans(t) for t in texts]
    words = [set(regex.findall(r"\p{L}{3,}", t.lower())) for t in texts]
    total = Counter(w for ws in words for w in ws)
    witnesses, pairs = {}, Counter()
    for text, spans in zip(texts, base):
        if spans and text not in witnesses:
            hidden = re.sub(BASE["email"], " ", text).lower()
            witnesses[text] = ({s[3].lower() for s in spans}, set(regex.findall(r"\p{L}{3,}", hidden)))
    for entities, terms in witnesses.values():
        pairs.update((e, t) for e in entities for t in terms)
    telling = defaultdict(dict)
    for (e, t), n in pairs.items():
        unknown = -math.log2(min(1.0, n / total[t])) if total[t] else math.inf
        if n >= pii.SUPPORT and unknown <= pii.GENERALISE_BITS:
            telling[e][t] = -1 if unknown <= pii.REMOVE_BITS else -2
    terms = []
    for text, spans in zip(texts, base):
        own = {}
        for e in {s[3].lower() for s in spans}:
            for t, kind in telling[e].items():
                own[t] = max(own.get(t, -2), kind)
        terms.append(sorted(
            (m.start(), own[m[0].lower()], m.end(), m[0]) for m in regex.finditer(r"\p{L}{3,}", text)
            if m[0].lower() in own and not any(s[0] < m.end() and m.start() < s[2] for s in spans)
        ))
    return base, terms


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(rows, column):
    return [[(s.start, s.kind, s.end, s.value) for s in r[column]] for r in rows]


TRICKY = [
    "", "no data", "a@b.com_x@y.com", "a@b@c.d x..y@q-.r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111-1111 1111",
    "4111  1111 1111 1111", "5" * 3000, "1.2" * 500, "a." * 2000 + "@b.c", "x@" + "a." * 3000 + "b", "+1 (499) 555-6503, +12345678 +1234567890123456",
    "é@b.c ü +49 30 1234567 \U0001F600 mail q@r.st", "+1+22+333 444 555 666", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
]


def test_base_spans_follow_the_stated_patterns(spark):
    rows = pii.with_base_spans(frame(spark, TRICKY)).orderBy("doc_id").collect()
    assert spans(rows, "base") == [base_spans(t) for t in TRICKY]


def test_terms_that_disclose_an_entity(spark):
    texts = [f"smithers writes from {k}: ann@b.com with the others {w}" for k, w in enumerate(("one", "two", "six", "ten"))]
    texts += ["with the others from there", "the writes", "from the writes", "others writes with"] * 4 + ["smithers alone"]
    rows = pii.sanitise(frame(spark, texts)).orderBy("doc_id").collect()
    base, terms = sanitised(texts)
    assert spans(rows, "base") == base and spans(rows, "terms") == terms
    assert [s[3] for s in terms[0]] == ["smithers"]
    assert rows[0].clean_text == " writes from 0: [email] with the others one"
    assert rows[-1].clean_text == "smithers alone"


def test_copies_are_one_witness(spark):
    texts = ["smithers ann@b.com"] * 9
    assert spans(pii.sanitise(frame(spark, texts)).collect(), "terms") == [[]] * 9


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = spark.createDataFrame([(None, None, 1), (1, "x a@b.cd y", 2), (1, "x a@b.cd y", 2)], "doc_id long, text string, base int")
    found = pii.sanitise(rows).collect()
    assert sorted((r.doc_id or 0, r.clean_text) for r in found) == [(0, ""), (1, "x [email] y"), (1, "x [email] y")]
    assert pii.sanitise(rows.limit(0)).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_the_query_against_brute_force(spark, size):
    folder = f"/root/testdata/{size}"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    base, terms = sanitised([d.text or "" for d in docs])
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, folder).collect()}
    assert len(got) == len(docs)
    for doc, own, more in zip(docs, base, terms):
        named = ",".join(f"{pii.KINDS[s[1]]}:{s[0]}:{s[2]}" for s in own)
        every = sorted([*((s[0], s[1], s[2]) for s in own), *((s[0], 9, s[2]) for s in more)])
        row = got[doc.doc_id]
        assert row.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in own) for k in range(4)]
        assert row.spans == ",".join(f"{pii.KINDS[k] if k < 9 else 'term'}:{a}:{b}" for a, k, b in every)


def test_a_text_of_very_many_matches(spark):
    import time

    n = 20_000
    text = " ".join(f"u{k % 977}@mail{k % 31}.org tel +49 30 12345{k % 90 + 10}" for k in range(n)) + " end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    (found,) = pii.sanitise(docs).collect()
    # The square of the matches would take minutes.
    assert time.monotonic() - start < 90
    assert [text[s["start"] : s["end"]] for s in found["base"]] == [s["value"] for s in found["base"]]
    assert len(found["base"]) == 2 * n
    assert found["clean_text"] == " ".join(["[email] tel [phone]"] * n) + " end"
