"""Personal data against Python's regular expressions, and contexts that discover more."""

import hashlib
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from sedge.llm import pii, queries

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    ds = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 13 <= len(ds) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(ds))) % 10 == 0
    return kind != "phone" or 9 <= len(ds) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_pii(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        joined = ",".join(":".join(map(str, x)) for x in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_odd_texts(spark):
    random.seed(3)
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "4111 1111 1111 1111 " * 700, 0), (3, "a" * 100000 + " x@y.zz", 0), (4, "1" * 60000, 0), (5, "+1 (017) 555-7713" * 300, 0)]
    for i in range(10, 1000):
        letters = random.choice(["a@.b-1 ", "0123456789 -", "+1(2) .-3x", "1.2.25 5", "é𝄞a@b.c1 2_%"])
        rows.append((i, "".join(random.choice(letters) for _ in range(random.randint(0, 90))), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, email int")
    got = pii.find_personal_data(df, ("doc_id", "text", "email")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(b) for b in r["base"]] == brute(r["text"])
    assert pii.find_personal_data(df.limit(0)).count() == 0
    assert pii.mask_personal_data(df).columns == df.columns


def test_contexts_discover(spark):
    random.seed(5)
    rows = []
    for i in range(300):
        n = "".join(random.choice("0123456789") for _ in range(10))
        if i % 3 == 0:
            rows.append((i, f"x{i % 7} call telephone: +1 {n[:3]} {n[3:6]} {n[6:]} now"))
        elif i % 17 == 0:
            rows.append((i, f"x{i % 7} call telephone: 555-{n[:3]}-{n[3:7]} now"))
        else:
            rows.append((i, f"the order number {n[:9]} was sent"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find_personal_data(df, ("doc_id", "text")).collect()}
    for i, t in rows:
        new = [tuple(x) for x in out[i]["extra"]]
        at = t.find("555-")
        assert new == ([("phone", at, at + 12)] if i % 3 and i % 17 == 0 else [])
    hidden = {r["doc_id"]: r["text"] for r in pii.mask_personal_data(df).collect()}
    assert hidden[17] == "x3 call telephone: [PHONE] now" and hidden[3] == "x3 call telephone: [PHONE] now" and hidden[1] == rows[1][1]


def test_masked_overlaps(spark):
    df = spark.createDataFrame([("héllo wörld", [("ip", 1, 4), ("card", 2, 6), ("email", 8, 11)])], "t string, s array<struct<kind:string,start:long,end:long>>")
    assert df.select(pii.masked(F.col("t"), F.col("s")).alias("m")).first()["m"] == "h[IP]wö[EMAIL]"


def split_matches(pattern, text):
    """(start, end, value, before, after): what stands between neighbouring matches, 60 characters at most."""
    ms = list(regex.finditer(pattern, text))
    edges = [0, *[m.end() for m in ms]], [*[m.start() for m in ms], len(text)]
    return [(m.start(), m.end(), m[0], text[edges[0][i] : m.start()][-60:], text[m.end() : edges[1][i + 1]][:60]) for i, m in enumerate(ms)]


def contexts(before, after):
    left, right = ([w for w in regex.split(r"[^\p{L}\p{N}:=#&]+", t.lower()) if w] for t in (before, after))
    made = [f"2 {left[-2]} {left[-1]}"] if len(left) > 1 else []
    made += [f"b {left[-1]} _ {right[0]}"] if left and right else []
    return made + ([f"1 {left[-1]}"] if left else [])


def plain_spans(texts):
    """Base and extra spans of each text, by dictionaries."""
    graph, places, base = {}, {}, {}
    for d, t in texts.items():
        base[d] = brute(t)
        seeds = [(k, x) for k in PATTERNS for x in split_matches(pii.BASE[k], t or "") if passes(k, x[2])]
        places[d] = [(x, kinds) for p, kinds in pii.CANDIDATES.values() for x in split_matches(p, t or "") if not any(b < x[1] and x[0] < e for _, b, e in base[d])]
        rows = [(x, k, True) for k, x in seeds]
        rows += [(x, k, k == "secret" and bool(re.search(pii.SECRET_SEED, x[2]))) for x, kinds in places[d] for k in kinds]
        for x, k, seed in rows:
            for p in contexts(x[3], x[4]):
                key = p, x[2].lower(), k
                graph[key] = graph.get(key, False) or seed
    n, seeds, all_ = Counter(), Counter(), {}
    for p in {(p, v) for p, v, _ in graph}:
        n[p[0]] += 1
    for (p, v, k), seed in graph.items():
        if seed:
            seeds[p, k] += 1
            all_.setdefault(k, set()).add(v)
    seeds = {(p, k): c for (p, k), c in seeds.items() if c >= min(10, max(4, -(-len(all_[k]) // 20)))}
    open_ = [(p, k, v) for (p, v, k), seed in graph.items() if not seed and (p, k) in seeds]
    conf = {x: c / (n[x[0]] + 1) for x, c in seeds.items()}
    for _ in range(3):
        score = {}
        for p, k, v in open_:
            score[k, v] = max(score.get((k, v), 0), conf[p, k])
        gain = Counter()
        for p, k, v in open_:
            gain[p, k] += round(score[k, v], 6)
        conf = {x: (c + gain[x]) / (n[x[0]] + 1) for x, c in seeds.items()}
    out = {}
    for d in texts:
        new = []
        for x, kinds in places[d]:
            told = [(conf[p, k], -pii.ALL_KINDS.index(k), k) for k in kinds for p in contexts(x[3], x[4]) if conf.get((p, k), 0) >= 0.8]
            if told:
                new.append((x[0], -x[1], max(told)[2]))
        at, extra = -1, []
        for a, b, k in sorted(new):
            if a >= at:
                extra.append((k, a, -b))
                at = -b
        out[d] = sorted([*base[d], *extra], key=lambda s: (pii.ALL_KINDS.index(s[0]), s[1]))
    return out


def test_all_spans_against_plain_python(spark):
    sf = SF.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = plain_spans(texts)
    got = {r["doc_id"]: r["spans"] for r in queries.op8_pii(spark, sf).collect()}
    assert got == {d: ",".join(":".join(map(str, s)) for s in x) for d, x in want.items()}
    # the contexts of secrets are found, and what stands there
    told = [d for d, t in texts.items() if re.search(r'token = "', t or "", re.I)]
    assert told and all("secret" in got[d] for d in told)
    assert sum("secret" in s for s in got.values()) == len(told)
