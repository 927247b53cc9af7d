"""Personal data: base spans against plain patterns, added spans by forms written into other texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parchmint.llm import personal

SCHEMA = "doc_id long, text string"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum((int(c) * 2 - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def model(spark, sf):
    return personal.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_shipped_documents(spark, sf, model, monkeypatch):
    monkeypatch.setattr(personal, "train", lambda *_: model)
    rows = {r.doc_id: r for r in personal.op13_personal_data(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d.doc_id], base(d.text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(shown(want).encode()).hexdigest()
        assert set(shown(want).split(",")) <= set(r.spans.split(","))


ODD = [
    None, "", " ", "a@b.c_d@e.f", "x@y.z@q.w", "..@a.b", "a@b", "a@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255", "001.02.3.000", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111",
    "+1 (017) 555-7713", "+1 555", "++12345678901", "+1 (017) 555-7713 4111111111111111", "x￿1.2.3.4￿￾ é日本😀 me@home.org", "😀 +49 (171) 234-5678😀", "4111111111111111@mail.com", "1 2 3 4 5 6 7 8 9 0 1 2 3 4",
]


def test_base_spans_of_odd_texts(spark, model):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(["1", "2", "4", ".", " ", "-", "+", "@", "a", "(", ")", "é", "9.9"]) for _ in range(r.randrange(1, 90))) for _ in range(300)]
    texts += ["7" * 60000, "a" * 200000, "a." * 60000, "1.1.1.1 " * 3000, "+1" + " " * 50000, "me@x.org, " * 2000, "1 " * 40000, "word " * 30000]
    wide = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({c: F.lit("me@x.org") for c in ("t", "b", "c", "base", "t_", "start", "kind", "f")})
    found = personal.scan(wide.repartition(6), model)
    assert set(wide.columns) | {"added"} == set(found.columns)
    rows = {x.doc_id: x for x in found.select("doc_id", "base", "added", personal.redacted(F.coalesce("text", F.lit("")), F.col("base")).alias("out")).collect()}
    for i, t in enumerate(texts):
        want = base(t)
        assert [tuple(x) for x in rows[i].base] == want, t[:80]
        assert all(a.end <= s or a.start >= e for a in rows[i].added for s, _, e in want)
        out, at = "", 0
        for s, k, e in want:
            out, at = (out, max(at, e)) if s < at else (out + t[at:s] + f"[{personal.KINDS[k]}]", e)
        assert rows[i].out == out + (t or "")[at:]


def planted(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(n))
    body = "4" + d(14)
    card = next(body + c for c in "0123456789" if luhn(body + c))
    account = d(18)
    iban = f"DE{98 - int(''.join(str(int(c, 36)) for c in account + 'DE00')) % 97:02d}{account}"
    return [
        ("email", f"{w(6)} [at] {w(7)} [dot] com"), ("email", f"{w(5)} at {w(6)} dot org"), ("email", f"{w(5)}(at){w(6)}.net"),
        ("ip", ":".join(["2001", *(f"{r.randrange(4096, 65536):x}" for _ in range(7))])),
        ("card", ".".join(card[i : i + 4] for i in range(0, 16, 4))), ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"tel. {d(3)}.{d(3)}.{d(4)}"), ("iban", iban), ("ssn", f"{d(3)}-{d(2)}-{d(4)}"),
    ]


def ordinary(r):
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return [f"version {d(1)}.{d(1)}.{d(2)}", f"order {d(8)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(3)}.{d(2)} per unit", f"at 1{d(1)}:{d(2)}:{d(2)}", f"page {d(3)}-{d(3)}", f"look at this. Then {d(4)}", f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"]


def test_planted_forms(spark, sf, model):
    """Recall and precision of forms that no base pattern finds, in texts of their own. Addresses written out without digits or
    brackets ("x at y dot org") are missed, and the README says so; of all others nine in ten are found."""
    r = random.Random(11)
    words = "stone river light paper glass wind salt iron moss fern birch pine oak der die und le la que".split()
    filler = lambda: " ".join(r.choice(words) for _ in range(r.randrange(3, 12)))
    texts, want = [], []
    for i in range(60):
        t, spans = filler() + " ", []
        for kind, s in planted(r):
            lead, s = ("tel. ", s[5:]) if s.startswith("tel. ") else ("", s)
            spans.append((kind, len(t + lead), len(t + lead + s)))
            t += lead + s + " " + filler() + " "
        texts.append((i, t))
        want.append(spans)
    clean = [(1000 + i, " ".join(filler() + " " + s for s in ordinary(r))) for i in range(60)]
    found = {x.doc_id: [(personal.KINDS[a.kind], a.start, a.end) for a in x.added] for x in personal.scan(spark.createDataFrame(texts + clean, SCHEMA), model).select("doc_id", "added").collect()}
    hit = sum(s in found[i] for i, spans in enumerate(want) for s in spans)
    total = sum(map(len, want))
    wrong = sum(s not in want[i] for i in range(60) for s in found[i]) + sum(len(found[i]) for i, _ in clean)
    missed = {(i, s) for i, spans in enumerate(want) for s in (spans[1],)}
    others = [(i, s) for i, spans in enumerate(want) for s in spans if (i, s) not in missed]
    assert sum(s in found[i] for i, s in others) >= 0.9 * len(others) and hit >= 0.85 * total and wrong <= 0.1 * hit, (hit, total, wrong)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = personal.train(none, fit=personal.Fit(trees=2, depth=2))
    assert personal.scan(none, model).count() == 0
