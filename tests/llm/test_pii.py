import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from helpers import DOCS, frame
from pyspark.sql import functions as F

from netlens.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(v):
    d = [int(c) for c in re.sub("[^0-9]", "", v)][::-1]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


def plain(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            v = m.group()
            n = len(re.sub("[^0-9]", "", v))
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 16 <= n <= 19 and luhn(v), "phone": 8 <= n <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "", None, "nothing here", "write to a.b@c-d.example.org, or x@y or a@b.c_d@e.f.", "a@b..c a@b.c. @x.y p@q.r@s.t", "+1 (415) 555-2671 and +12 and +1234567 8, +1+44 20 7946 0958.",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 4111111111111111 5500 0000 0000 0004.", "4111 1111 1111 1111 1111 1111",
    "é😀 mail: zoë.x@ex.am.ple 😀 4111111111111111", "12--34 - 5 " * 20, "a" * 5000 + "@" + "b.c" * 3, "9" * 3000, "+" * 50 + "1" * 9, "1-2 3-4 " * 50, "0.0.0.0 10.20.30.40x",
]


@pytest.mark.parametrize("many", [1, 300])
def test_base_spans_match_the_plain_patterns(spark, many):
    rows = [(k, t) for k, t in enumerate(TEXTS)] if many == 1 else [(0, "m@n.op 1.2.3.4 " * many), (0, "m@n.op 1.2.3.4 " * many), (None, "q@r.st")]
    got = pii.pii_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: plain(t or "") for i, t in rows}
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == want[r["doc_id"]], r["doc_id"]


def test_terms_that_tell_an_entity_are_spans_and_clean_texts_stay(spark):
    rows = [(k, f"filler{k} common words patient {name} reachable under {name}@mail.example always.") for k, name in enumerate(["zoeprivate"] * 5 + ["other"])]
    rows += [(k, "common words and always reachable under patient conditions") for k in range(10, 60)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert all(not got[k] for k in range(10, 60))
    text = rows[0][1]
    terms = {text[s["start"] : s["end"]] for s in got[0] if s["kind"] == "term"}
    assert "zoeprivate" in terms and not terms & {"common", "always", "reachable"}
    assert [(s["kind"], s["value"]) for s in got[5]] == [("email", "other@mail.example"), ("term", "other")]


def test_a_name_beside_one_address_in_one_document_is_a_term(spark):
    rows = [(0, "please ask quillfeather under q@mail.example always")] + [(k, "please ask under always") for k in range(1, 40)]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert [(s["kind"], s["value"], s["ratio"]) for s in got[0]] == [("email", "q@mail.example", None), ("term", "quillfeather", 1.0)]
    assert not any(got[k] for k in range(1, 40))


def test_terms_count_by_document_and_every_mention_is_a_span(spark):
    far = "quillfeather wrote. " + "please ask under always. " * 40 + "To q@mail.example, said Quillfeather. " + "please ask under always. " * 40 + "é quillfeather"
    rows = [(None, far)] * 15 + [(k, "please ask to under always wrote said é") for k in range(1, 40)]
    got = pii.pii_spans(frame(spark, rows)).where("size(base) > 0").collect()
    want = [(m.start(), m.end(), "quillfeather") for m in re.finditer("quillfeather", far.lower())]
    assert len(got) == 15 and len(want) == 3
    assert all([(s["start"], s["end"], s["value"]) for s in r["spans"] if s["kind"] == "term"] == want for r in got)


def test_places_of_many_words(spark):
    text = " ".join(f"w{'x' * (k % 7)} é" for k in range(300))
    got = spark.createDataFrame([(text,), ("",), ("a",)], "t string").select(pii._words(F.col("t")).alias("w"))
    assert [[tuple(w) for w in r["w"]] for r in got.collect()] == [[(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)] for t in (text, "", "a")]


def brute(rows, threshold):
    """Term spans and sanitised texts of all rows, by plain loops over every entity and term."""
    docs = sorted({(str(i), i, t or "") for i, t in rows})
    words = lambda t: [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t)]
    base = {t: plain(t) for _, _, t in docs}
    ent = {t: {f"{k}:{t[a:b].lower()}" for k, a, b in base[t]} for _, _, t in docs}
    n_ent, n_term, both = Counter(), Counter(), Counter()
    for _, _, t in docs:
        terms = {w for w, _, _ in words(t)}
        n_ent.update(ent[t])
        n_term.update(terms)
        own = {w for w, a, b in words(t) if not any(x < b and y > a for _, x, y in base[t])}
        both.update((e, w) for e in ent[t] for w in own)
    out = {}
    for _, _, t in docs:
        found = [(k, a, b, None) for k, a, b in base[t]]
        for w, a, b in words(t):
            if any(x < b and y > a for _, x, y in base[t]):
                continue
            ratio = max((math.log(len(docs) * both[e, w] / (n_ent[e] * n_term[w])) / math.log(len(docs) / n_ent[e]) for e in ent[t] if n_ent[e] < len(docs)), default=0)
            if ratio >= threshold - 1e-9:
                found.append(("term", a, b, ratio))
        text, at = "", 0
        for k, a, b, r in sorted(found, key=lambda s: (s[1], s[2])):
            if a >= at:
                text += t[at:a] + (f"[{k.upper()}]" if k != "term" else "" if r >= pii.REMOVE else "[TERM]")
            at = max(at, b)
        out[t] = found, text + t[at:] if found else None
    return out


def test_spans_and_sanitised_texts_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("mar", "lo", "tü", "quin", "ze") for b in ("ta", "ben", "x", "rö", "dd", "li")]
    people = [f"p{k}.{rng.choice(vocab)}@m{k % 3}.example" for k in range(12)] + ["10.1.2.3", "+1 (415) 555-2671", "4111 1111 1111 1111", "zoë.x@ex.am.pleé"]
    rows, rare = [], [f"{v}{w}" for v in vocab for w in ("ska", "Nor")]
    for k in range(60):
        parts = rng.sample(rare, 2) + [rng.choice(vocab) for _ in range(rng.randrange(1, 30))] + rng.sample(people, rng.choice([0, 0, 1, 1, 2, 4]))
        rng.shuffle(parts)
        rows.append((rng.choice([k, None, 7]), " ".join(parts)))
    rows += rng.choices(rows, k=15) + [(1, None), (2, ""), (3, "+1.2.3.4.567 8901 and 4111-1111-1111-1111"), (4, "x" * 3000 + " a@b.cd " + "é" * 2500)]
    want = brute(rows, pii.THRESHOLD)
    got = pii.pii_spans(frame(spark, rows)).collect()
    texts = sorted(((str(i), t or "") for i, t in rows))
    assert len(got) == len(rows) and sum(s["kind"] == "term" for r in got for s in r["spans"]) > 20
    seen = sorted((str(r["doc_id"]), [(s["kind"], s["start"], s["end"], s["ratio"] and round(s["ratio"], 9)) for s in r["spans"]], r["sanitised"]) for r in got)
    assert seen == sorted((i, [(k, a, b, r and round(r, 9)) for k, a, b, r in want[t][0]], want[t][1]) for i, t in texts)


def test_time_grows_with_the_number_of_matches(spark):
    took = []
    for n in (5_000, 20_000, 100_000):
        text = "".join(f"u{k}@m.example, tel +1 415 555 {k % 9000 + 1000}; " for k in range(n))
        began = time.time()
        df = spark.createDataFrame([(text,)], "t string").select(pii.base_spans(F.col("t")).alias("b"), pii._words(F.col("t")).alias("w"), F.col("t"))
        df = df.select(F.size("b").alias("n"), F.size("w"), F.length(pii.sanitise(F.col("t"), F.transform("b", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"], F.lit(None).cast("double").alias("ratio"))))))
        assert df.first()["n"] == 2 * n
        took.append(time.time() - began)
    assert took[2] < 20 * took[1] + 5, took


def test_sanitise(spark):
    df = pii.pii_spans(frame(spark, [(k, "call zoeprivate now: zoeprivate@x.example, 1.2.3.4!") for k in range(4)] + [(9, "call now")] * 30))
    texts = frame(spark, [(k, "call zoeprivate now: zoeprivate@x.example, 1.2.3.4!") for k in range(4)])
    out = df.join(texts.select("doc_id", "text"), "doc_id").select(pii.sanitise(texts["text"], df["spans"]).alias("t")).collect()
    assert all("zoeprivate" not in r["t"] and "[EMAIL]" in r["t"] and "[IP]!" in r["t"] for r in out)


def test_empty_table(spark):
    assert pii.pii_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_query_digests(spark, sf_dir):
    from netlens.llm.queries import op1_pii_sanitise

    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_pii_sanitise(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        spans = plain(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in spans) for k in BASE]
