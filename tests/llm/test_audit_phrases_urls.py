import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from varloom.llm import collocations, filter_audit, url_filter

PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# filter audit


def audited(rows, labels):
    """Brute force: every document through every order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for p in {s or "" for *_, s in rows}:
        docs = []
        for i, t, s in rows:
            if (s or "") != p:
                continue
            t = t or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            tests = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]
            docs.append((i, {f for f, x in zip("ABCDE", tests) if x}))
        shapley = Counter()
        for o in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(o, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[p, o, step] = [len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for k in [k for k in out if k[0] == p]:
            out[k].append(shapley[k[1][k[2] - 1]])
    return out


def test_audit_equals_brute_force(spark, hard):
    rng = random.Random(11)
    base = [" ".join(rng.choice(["red", "green", "BLUE", "a#b", "x", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    texts = hard + base + [rng.choice(base) for _ in range(60)] + ["same"] * 30
    rows = [(i, t, rng.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [(None, base[0], "a"), (None, None, None), rows[15], (rows[15][0], rows[15][1], "b"), (3, "other text of a used id", "a")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 100, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("mine"), "mask": F.lit(1), "id": F.lit("x")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(docs, marks).collect()}
    assert got == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_removals_cover_each_order_once():
    for mask in range(1, 32):
        seen = Counter(r for m, _, lo, hi in filter_audit.removals("ABCDE") if m == mask for r in range(lo, hi))
        assert seen == Counter(range(120))
    assert filter_audit.orders("ABC") == ["".join(p) for p in permutations("ABC")]


# collocations


def mined(rows, least, top):
    f, n = {}, Counter()
    for text, lang in rows:
        c = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in PIECE.split(low(text or "")):
            w = WORD.findall(piece)
            n["und" if lang is None else lang] += len(w)
            c.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            holders = [q for q, b in c.items() if b >= least and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not holders:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark, hard):
    rng = random.Random(12)
    zipf = [f"w{i}" for i in range(40) for _ in range(40 // (i + 1))] + ["Ünï", "ß", "Ab", "漢"]
    rows = [("".join(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) + (rng.choice(zipf) if rng.random() < 0.8 else "in the end of Days") for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", "", None, "und"])) for _ in range(150)]
    rows += [(t, "en") for t in hard] + [("a b a b a b a b " * 50, "en"), ("x" * 300 + " y", "de")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"w": F.lit(1), "h": F.lit("x"), "c": F.lit(2)})
    want = mined(rows, 5, 40)
    order = lambda df: sorted(tuple(r) for r in df.collect())
    assert order(collocations.collocations(docs, least=5, top=40)) == want
    # several tries a level give the same
    assert order(collocations.collocations(docs, least=5, top=40, most=25)) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_long_texts_hash_as_short_ones(monkeypatch):
    rng = random.Random(13)
    text = "".join(rng.choice(["aB", "c", " ", ".", "\t", "é", "漢字", "q" * 90]) for _ in range(900))
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None or "de"]), pa.array([text, "tail words"])], ["lang", "text"])
    whole = [np.concatenate(x) for x in zip(*[(h, own, b - a) for h, _, a, b, _, own in collocations.tokens(batch)])]
    pieces = np.concatenate([p for _, p, *_ in collocations.tokens(batch)])
    for size in (7, 64, 500):
        monkeypatch.setattr(collocations, "SLICE", size)
        cut = [np.concatenate(x) for x in zip(*[(h, own, b - a) for h, _, a, b, _, own in collocations.tokens(batch)])]
        assert all((x == y).all() for x, y in zip(whole, cut))
        first = next(iter(collocations.tokens(batch)))[1]
        assert (np.diff(first) > 0).tolist() == (np.diff(pieces)[: len(first) - 1] > 0).tolist()


def test_trie_finds_its_phrases_only():
    rng = np.random.default_rng(14)
    words = rng.integers(1, 1 << 63, 3000, dtype=np.uint64)
    phrases = np.unique(words[rng.zipf(1.3, (4000, 3)) % 3000], axis=0)
    t = collocations.Trie(phrases)
    text = words[rng.zipf(1.3, 20000) % 3000]
    number = {tuple(p): i for i, p in enumerate(phrases)}
    want = [number.get(tuple(text[i : i + 3]), -1) for i in range(len(text))]
    assert t.at(text).tolist() == want and max(want) >= 0
    assert t.at(text[:2]).tolist() == [-1, -1] and (t.at(rng.integers(1, 1 << 63, 50, dtype=np.uint64)) == -1).all()
    assert (collocations.Trie(words[:1].reshape(1, 1)).at(words[:5])).tolist() == [0, -1, -1, -1, -1]


# addresses


def decided(url, rules, otherwise):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = low(host)
    best = None
    for h, p, v in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or "") and (best is None or (len(h) + len(p or ""), len(h), v) > best[0]):
            best = (len(h) + len(p or ""), len(h), v), h + (p or "")
    return host, path, best and best[1], best[0][2] if best else otherwise


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(15)
    labels, parts = ["com", "org", "a", "b", "www", "é"], ["/", "/en", "/en/", "/a", "/ab", "/a/b", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(120)]
    rules += [(h, p, "block") for h, p, _ in rules[:5]] + [("", "/", "block"), (None, "/", "block"), ("com", None, "allow")]
    urls = [f"http://{host()}{path()}{rng.choice(['', '?q=/en/', '#top', '/x'])}" for _ in range(600)]
    urls += [None, "", "no scheme", "://", "http://", "http://COM/EN/", "ftp://x://a.com/en/", "http://a.com:80/", "http://.com/", "http://com./", "http://a..com/a", "http://a.com\n.b/en/\n", "http://a.com/" + "y" * 5000] + ["http://www.a.com/a/b/c"] * 300
    rows = [(i % 900, u) for i, u in enumerate(urls)] + [(None, urls[0]), (0, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "range": F.lit("r"), "key": F.lit("k"), "rule": F.lit(2)})
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    order = lambda x: sorted(x, key=repr)
    out = url_filter.judged(pages, frame, keep=("page_id", "range", "key", "host"), otherwise="none")
    assert out.columns == ["page_id", "range", "key", "host", "path", "rule", "verdict"]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()]
    assert order(got) == order((i, *decided(u, rules, "none")) for i, u in rows)
    assert url_filter.judged(pages.limit(0), frame).count() == 0
    assert url_filter.judged(pages, frame.limit(0)).filter("verdict <> 'allow'").count() == 0
