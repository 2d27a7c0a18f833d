"""The training-data operators against brute force, and on odd and empty tables."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import bpe, exact_dedup, langid, minhash, multi_index, packing, pii, queries, secret_scan, sharding, toxicity
from paperloom.runtime import sliced

JSON, PATTERN, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def rows(df):
    return [r.asDict() for r in df.collect()]


# PII


def brute_spans(text):
    """The contract's patterns, tried at every place."""
    out = []
    shapes = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for kind, shape in shapes.items():
        for m in re.finditer(shape, text):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                ok = 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            else:
                ok = kind == "email" or 8 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


def test_pii_base_equals_brute_force(sample_docs):
    r = random.Random(1)
    texts = ["".join(r.choice("ab1 234567890.@+-()%_é\n") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [x["text"] for x in sample_docs.select("text").collect()] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.45.6.7.8", "0000000000000000", "+1 (2) 345-6789 +12"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


def test_crf_learns_and_decodes_like_brute_force():
    crf = pii.default_model()
    held = pii.labelled_table(200, seed=77)
    got = crf.decode([w for ws, _ in held for w in ws], [len(ws) for ws, _ in held])
    want = [s for _, ss in held for s in ss]
    assert np.mean([pii.STATES[g] == w for g, w in zip(got, want)]) > 0.97
    words = ["call", "(555)", "123-4567", "now"]
    ids = crf.ids(words)
    e = crf.rows[1][ids].copy()
    e[1:] += crf.rows[0][ids[:-1]]
    e[:-1] += crf.rows[2][ids[1:]]
    best = max(itertools.product(range(len(pii.STATES)), repeat=4), key=lambda s: sum(e[t, s[t]] for t in range(4)) + sum(crf.transitions[a, b] for a, b in zip(s, s[1:])))
    assert tuple(crf.decode(words, [4])) == best


def test_pii_adds_spans_and_masks(spark):
    text = "Call (555) 123-4567 or john at example dot com. plain words x@y.org +49 30 1234567"
    df = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    r = {x["id"]: x for x in rows(pii.find_pii(df))}
    assert (r[1]["n_email"], r[1]["n_phone"]) == (1, 1) and {f["kind"] for f in r[1]["found"]} == {"email", "phone"} and len(r[1]["found"]) == 4
    assert r[2]["spans"] == r[3]["spans"] == "" and r[2]["masked_text"] is None
    m = {x["doc_id"]: x for x in rows(pii.mask(df))}
    assert m[1]["text"] == "Call [PHONE] or [EMAIL]. plain words [EMAIL] [PHONE]" and m[1]["n_chars"] == len(m[1]["text"])


def test_pii_parts_of_one_run():
    crf = pii.default_model()
    for text, want in [
        ("555-123-4567, 555-987-6543", "[PHONE], [PHONE]"), ("(555) 123-4567 (555) 987-6543", "[PHONE] [PHONE]"), ("SSN:219-09-9999", "SSN:[SSN]"), ("ssn 219-09-9999 457-55-5462", "ssn [SSN] [SSN]"),
        ("7536784127813050 4845168114407329", "[CARD] [CARD]"), ("here 4111 1111 1111 1111 5500 0000 0000 0004 there", "here [CARD] [CARD] there"),
        ("iban DE89370400440532013000 FR1420041010050500013M02606", "iban [IBAN] [IBAN]"), ("john at example dot com mary at sample dot org", "[EMAIL] [EMAIL]"),
    ]:
        assert pii.masked(text, pii.scan(crf, [text])[0][1]) == want
    r = random.Random(3)
    for _ in range(300):  # all words of one state: the parts cover as much as any choice of whole words
        kind = r.choice(["card", "phone", "ssn"])
        words = [r.choice(["4111111111111111", "5500000000000004", "123", "555-123-4567", "219-09-9999", "1234567890123456", "(555)", "-"]) + r.choice(["", "", ","]) for _ in range(r.randint(1, 6))]
        text = " ".join(words)
        places = [m.span() for m in pii._WORD.finditer(text)]
        found = pii.parts(kind, text, places)
        most = [0]
        for n in range(1, len(places) + 1):
            each = [(m, *pii.trimmed(text, places[m][0], places[n - 1][1])) for m in range(n)]
            most.append(max([most[-1], *(most[m] + sum(c.isalnum() for c in text[i:j]) for m, i, j in each if pii.plausible(kind, text[i:j]))]))
        assert sum(c.isalnum() for _, i, j in found for c in text[i:j]) == most[-1], (kind, text)
        assert all(pii.plausible(k, text[i:j]) for k, i, j in found) and all(x[2] <= y[1] for x, y in zip(found, found[1:]))


# Nearest neighbours


def test_multi_index_recall_and_scores(spark):
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], float) for r in emb.collect()}
    got = defaultdict(list)
    for r in queries.op2_inverted_multi_index(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in [i for i in x if i % 100 == 0]:
        true = sorted((math.dist(x[q], v), i) for i, v in x.items() if i != q)[:10]
        assert len(got[q]) == 10 and all(abs(math.dist(x[q], x[i]) - s) < 1e-12 for i, s in got[q])
        hit += len({i for _, i in true} & {i for i, _ in got[q]})
    assert hit / (10 * len(got)) >= 0.9


@pytest.mark.parametrize("n", [30, 300])
def test_multi_index_recall_of_small_tables(spark, n):
    r = np.random.default_rng(n)
    x = np.round(r.normal(size=(n, 6)), 3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for row in multi_index.nearest(df, df.where("vec_id % 10 = 0"), k=5).collect():
        got[row["query_id"]].add(row["vec_id"])
    hit = 0
    for q, found in got.items():
        hit += len(found & {i for _, i in sorted((math.dist(x[q], x[i]), i) for i in range(n) if i != q)[:5]})
    assert len(got) == n // 10 and hit / (5 * len(got)) >= 0.9


def test_multi_index_odd_vectors(spark):
    bad = [(3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 2.0])]
    same = [(10 + i, [1.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), *bad, *same], "vec_id long, embedding array<double>")
    out = rows(multi_index.nearest(df, df.where("vec_id % 100 = 0"), recall=1.0).orderBy("rank"))
    assert [(r["rank"], r["vec_id"]) for r in out] == [(i + 1, v) for i, v in enumerate([1, 2, *range(10, 18)])]
    assert multi_index.nearest(df.limit(0), df.limit(0)).count() == 0


def test_walk_is_in_order():
    r = np.random.default_rng(0)
    b = multi_index.Codebooks(r.normal(size=(6, 2)), r.normal(size=(5, 2)), 1.0)
    a, c = r.normal(size=6), r.normal(size=5)
    order = b.walk(a, c, np.ones(30, int), np.inf)
    sums = [a[x // 5] + c[x % 5] for x in order]
    assert sorted(order) == list(range(30)) and sums == sorted(sums)


# Secrets


def test_secret_base_equals_brute_force(sample_docs):
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdef12", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "ſecret", "-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + [x["text"] for x in sample_docs.select("text").collect()]
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), letters("api") + "_?" + letters("key")])
    for t in texts:
        want = [("assign", *m.span()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secret_scan.base_spans(t) == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))), t


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("") == 0 and cost("password") < cost("passw0rd") < cost("x7Kp29!vQz")
    assert cost("aaaaaaaaaaaa") < 4 and cost("qwertyuiop") < 4 and cost("19991231") < 5 and cost("passwordqwerty2001") < 8
    assert cost("x" * 5000) < 10  # linear time
    base, every = secret_scan.scan("the passphrase is x7Kp29!vQz here, password is hunter, pwd = letmein1")
    assert base == [] and [s[0] for s in every] == ["guess"]


def cheapest(value):
    """All ways to cut value into spans, each at the least cost of its kinds."""
    s_ = secret_scan

    def span(s):
        costs = [sum(map(s_._char_cost, s))]
        if 3 <= len(s) <= s_.LONGEST and (c := s_.word_cost(s)) is not None:
            costs.append(c)
        if (c := s_.date_cost(s)) is not None:
            costs.append(c)
        costs += [sum(map(s_._char_cost, s[:u])) + math.log10(len(s) // u) for u in range(1, 9) if len(s) % u == 0 and len(s) // u >= 3 and s == s[:u] * (len(s) // u)]
        ways = [s_.step(a, b) for a, b in zip(s, s[1:])]
        if len(s) >= 3 and None not in ways:
            costs.append(math.log10(47 * len(s)) + math.log10(4) * sum(a != b for a, b in zip(ways, ways[1:])))
        return min(costs)

    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min(best[i] + s_.SPAN_COST + span(value[i:j]) for i in range(j)))
    return max(0.0, best[-1] - s_.SPAN_COST)


def test_guess_cost_is_the_minimum():
    texts = ["".join(x) for k in range(1, 7) for x in itertools.product("asd", repeat=k)] + ["".join(x) for x in itertools.product("12a", repeat=5)]
    r = random.Random(8)
    for alphabet in ("ab", "qwertasdf", "0192-", "passwordP@50", "aA1"):
        for _ in range(60):
            s = "".join(r.choice(alphabet) for _ in range(r.randint(1, 24)))
            texts.append(s + s[-r.randint(1, 8) :] * r.choice([0, 0, 3, 5]))
    texts += ["passwordfghjkl", "passwordfghjklz1", "2001-12-311999", "qwertyqwertyqwerty", "dragon19991231", "a" * 60 + "b" * 60]
    for t in texts:
        assert abs(secret_scan.guess_cost(t) - cheapest(t)) < 1e-9, t
    assert secret_scan.scan("password is passwordfghjklz1")[1] == []


def test_guess_cost_reaches_values_of_joined_names():
    for text, value in [
        ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", "wJalrXUtnFEMI/K7MDENG"), ('db_pwd = "x7Kp29!vQz"', "x7Kp29!vQz"), ("MY_PASSPHRASE: x7Kp29!vQz", "x7Kp29!vQz"), ('DB_PASSWORD="!x7Kp29vQz"', "!x7Kp29vQz"),
        ('client_secret: "$x7Kp29!vQz"', "$x7Kp29!vQz"), ("secret_key = x7Kp29!vQzzz", "x7Kp29!vQzzz"), ("clientPwdOld => x7Kp29!vQz", "x7Kp29!vQz"), ("my_passcode is x7Kp29!vQz", "x7Kp29!vQz"),
    ]:
        assert [text[i:j] for _, i, j in secret_scan.scan(text)[1]] == [value], text
    assert secret_scan.scan("db_pwd = letmein1, MY_PASSPHRASE: password, the secretary is well-organised")[1] == []
    assert secret_scan.scan("secret" * 20_000) == ([], [])  # linear time


def test_guess_cost_alone_decides_after_a_sign():
    found = lambda t: [t[i:j] for _, i, j in secret_scan.scan(t)[1]]
    assert found("passphrase: kqzvXwPtRbnLmYdG") == found("the pwd = kqzvXwPtRbnLmYdG") == ["kqzvXwPtRbnLmYdG"]
    assert found("passphrase: letmein, the passphrase is overwhelming, bearer instruments") == []


# Near and exact duplicates


def brute_components(texts, width, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def family(n=120, words=60, seed=4):
    """Copies of one text with more and more edits: chains of links, and many pairs just below the threshold."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(words)] = f"e{r.randint(0, 30)}"
        out[i] = " ".join(w)
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = family() | {1000 + i: f"{a} {b}" for i, (a, b) in enumerate(itertools.product("abc", "xyz"))} | {2000: "A b\tC", 2001: "a B c", 2002: "", 2003: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width=4).collect()}
    assert got == brute_components(texts, 4, 80)


def test_near_duplicates_odd(spark, odd):
    got = rows(minhash.near_duplicates(odd))
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append((r["component_id"], r["kept"]))
    assert by[1] == [(1, True)] and by[2] == [(1, False)] * 2 and by[3] == [(3, True)] and sorted(by[None], key=str) == [(1, False), (None, True)]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, odd, keep):
    got = rows(exact_dedup.exact_duplicates(odd, keep=keep, memtable_rows=2, bucket_rows=3))
    levels = rows(exact_dedup.exact_duplicates(odd, keep=keep, memtable_rows=1, bucket_rows=1, fan_in=2, broadcast_rows=0))  # several levels, all rows by exchange
    key = lambda r: str(sorted(r.items()))
    assert sorted(got, key=key) == sorted(levels, key=key)
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    first, empty = (1, 3) if keep == "smallest" else (2, 4)
    assert by[1] == [(first, 3, first == 1)] and by[2] == [(first, 3, first == 2)] * 2 and by[3] == [(empty, 2, empty == 3)]
    assert by[None] == [(None, 1, True)] * 2 and by[5] == [(5, 1, True)] and len(got) == odd.count()
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_runs_filters_and_merge():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(50)]
    keys = np.array(sorted(digests[:40]), dtype="V32")
    f = exact_dedup.make_filter(keys)
    assert exact_dedup.in_filter(f, keys).all() and exact_dedup.in_filter(f, np.array(digests[40:], dtype="V32")).sum() <= 2
    runs = []
    for part in ({digests[i]: [i, 1] for i in range(30)}, {digests[i]: [i + 100, 2] for i in range(25, 45)}):
        runs += exact_dedup._flush(part, "r", 1).to_pylist()
    k, v, n = exact_dedup.merge_runs(runs)
    got = {bytes(x): (int(a), int(b)) for x, a, b in zip(k, v, n)}
    assert got == {digests[i]: (i, 3) if i < 30 else (i + 100, 2) for i in range(25, 45)}


# Language and toxicity


def test_language_accuracy_and_odd_texts(spark, odd):
    got = queries.op5_hierarchical_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.97 and got.where("score < 0 or score > 1").count() == 0
    out = rows(langid.identify(odd))
    assert len(out) == odd.count() and {r["lang_pred"] for r in out if r["text"] in (None, "", "1234 5678 !!")} == {"und"} and "digest" in out[0]
    assert langid.identify(odd.limit(0)).count() == 0


def test_language_and_toxicity_queries_equal_a_plain_loop(spark, sample_docs):
    """The queries' rows against the fitted models applied text by text on the driver, and the folds against zlib's crc32."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in sample_docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    learned = sample_docs.where(F.col("doc_id").isin([i for i, out in fold.items() if not out]))
    languages = langid.train(learned, "doc_id", "text", "lang")
    got = {r["doc_id"]: r for r in queries.op5_hierarchical_language_id(spark, sf).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == fold
    for i, t in texts.items():
        lang, score = languages.predict(t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-6
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.col("doc_id").isin([i for i, out in fold.items() if not out]))
    model = toxicity.train(sample_docs, labels)
    got = {r["doc_id"]: r for r in queries.op6_weak_supervision_toxicity(spark, sf).collect()}
    assert {i: r["held_out"] for i, r in got.items()} == fold
    for i, t in texts.items():
        score = model.score(t)
        assert abs(got[i]["score"] - score) < 1e-9 and got[i]["predicted"] == int(score >= 0.5)


def test_names_that_clash(spark):
    inner = ["id", "v", "r", "ids", "one", "cell", "block", "part", "cells", "query_id", "rank", "score"]
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(12)], "vec_id long, embedding array<double>").select("*", *[F.col("vec_id").alias(c) for c in inner])
    out = rows(multi_index.nearest(emb, emb.where("vec_id = 0"), k=3, recall=1.0).orderBy("rank"))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in out] == [(1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)]
    docs = spark.createDataFrame([(1, "der Hund und die Katze", "de", "x"), (2, "the dog and the cat", "en", "y")], "doc_id long, text string, lang string, lang_pred string").withColumns({"held_out": F.lit("h"), "score": F.lit("s"), "t": F.lit(1), "y": F.lit(2)})
    out = langid.identify(docs)
    assert out.columns.count("lang_pred") == out.columns.count("score") == 1 and out.schema["score"].dataType.simpleString() == "double" and out.count() == 2
    names = ["id", "digest", "body", "hit", "mark", "stays", "key", "n", "bands", "rep", "component", "ids", "start", "class", "salt", "spans", "found"]
    odd_names = docs.select("doc_id", "text", *[F.lit(1).alias(c) for c in names])
    for run in (pii.find_pii, secret_scan.find_secrets, exact_dedup.exact_duplicates, minhash.near_duplicates):
        assert run(odd_names).count() == 2
    assert bpe.round_trip(odd_names, RANKS, PATTERN).count() == 2 and packing.pack(odd_names, JSON, PATTERN, 1).count() == 2


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_weak_supervision_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in got)
    assert wrong <= 0.06 * len(got) and not any(r["predicted"] and not r["toxic"] for r in got)


def test_label_model_recovers_accuracies_and_correlations():
    r = np.random.default_rng(1)
    n = 8000
    y = r.random(n) < 0.1
    fires = [(0.6, 0.02), (0.5, 0.01), (0.7, 0.03), (0.4, 0.02), (0.6, 0.01), (0.5, 0.02), (0.05, 0.05)]
    votes = np.stack([np.where(y, r.random(n) < a, r.random(n) < b) for a, b in fires], axis=1)
    echo = np.where(r.random(n) < 0.9, votes[:, 0], np.where(y, r.random(n) < 0.6, r.random(n) < 0.02))  # mostly a copy of the first voter
    votes = np.hstack([votes, echo[:, None]]).astype(float)
    m = toxicity.label_model(votes, 0.1)
    assert ((m.posterior > 0.5) == y).mean() > 0.98 and abs(m.balance - 0.1) < 0.02
    for j, (a, b) in enumerate(fires):
        assert abs(m.fires[1, j] - a) < 0.06 and abs(m.fires[0, j] - b) < 0.01
    assert m.parent.tolist() == [-1] * 7 + [0]
    for c, got in enumerate(m.correlation(7)):
        assert abs(got - np.corrcoef(votes[y == c][:, 0], votes[y == c][:, 7])[0, 1]) < 0.05
    alone = toxicity.label_model(np.delete(votes, 7, axis=1), 0.1)  # the echo adds no evidence
    assert np.abs(alone.posterior - m.posterior).mean() < 0.01


def test_toxicity_repeated_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(i, "you stupid fool" if i % 4 == 0 else "a plain text") for i in range(80)], "doc_id long, text string")
    rows_ = [(i, int(i % 4 == 0)) for i in range(80)]
    once = toxicity.train(docs, spark.createDataFrame(rows_, "doc_id long, toxic int"))
    again = toxicity.train(docs, spark.createDataFrame(rows_ * 3, "doc_id long, toxic int"))
    both = toxicity.train(docs, spark.createDataFrame([*rows_, (0, 0), (1, 1)], "doc_id long, toxic int"))
    assert once.voters == again.voters and np.allclose(once.weights, again.weights)
    for m in (once, both):
        assert m.score("what a stupid fool") > 0.5 > m.score("a plain text")
    assert set(once.accuracy) == set(once.voters) and once.correlations == {}  # the class alone explains these votes


def test_toxicity_odd(spark, odd):
    model = toxicity.train(odd, spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int"))
    out = rows(toxicity.score(odd, model))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out) and toxicity.score(odd.limit(0), model).count() == 0


# Sharding


def check_shards(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = Counter({s: n for s, n in enumerate(sharding.shard_sizes(len(got), shards)) if n})
    assert sorted(map(len, slots.values())) == sorted(sizes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_exact_and_repeatable(spark, sample_docs):
    docs = sample_docs.select("doc_id", F.lit("old").alias("slot"), "source").repartition(6, "doc_id")
    got = rows(sharding.shuffle_into_shards(docs, ["doc_id"], 7, part_rows=10))
    again = rows(sharding.shuffle_into_shards(docs, ["doc_id"], 7, part_rows=10))
    key = lambda r: r["doc_id"]
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == docs.count()
    check_shards(got, 7)
    other = rows(sharding.shuffle_into_shards(docs, ["doc_id"], 7, seed=1))
    check_shards(other, 7)
    assert sum(a["shard"] == b["shard"] for a, b in zip(sorted(got, key=key), sorted(other, key=key))) < len(got) / 3


def test_sharding_query_equals_brute_force(spark, sample_docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in sample_docs.collect()}
    got = rows(queries.op7_hypergeometric_sharding(spark, "/root/testdata/sf0.001"))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    assert len(got) == len(texts) and {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)} and {r["shard"] for r in got} == set(range(16))
    check_shards(got, 16)


def test_sharding_odd(spark, odd):
    internal = ["row", "first", "place", "source", "ends", "second", "part", "at", "n", "offset", "_block", "_first", "_second", "shard", "slot"]
    clash = odd.select("doc_id", "text", *[F.col("doc_id").alias(c) for c in internal])
    got = sharding.shuffle_into_shards(clash, ["doc_id", "text"], 3)
    assert got.columns == [c for c in clash.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    check_shards(rows(got), 3)
    assert all(r["place"] == r["_second"] == r["doc_id"] for r in rows(got))
    assert sharding.shuffle_into_shards(odd.limit(0), ["doc_id"], 3).count() == 0
    same = spark.createDataFrame([(None, "x")] * 300, "doc_id long, text string")  # equal in all keys: still spread over parts
    out = rows(sharding.shuffle_into_shards(same, ["doc_id"], 3, part_rows=10))
    check_shards(out, 3)


def test_hypergeometric_law():
    r = random.Random(3)
    n = Counter(sharding.hypergeometric(r, 5, 7, 4) for _ in range(20_000))
    for k in range(5):
        want = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(n[k] / 20_000 - want) < 0.015
    draws = [sharding.hypergeometric(r, 10**10, 15 * 10**10, 10**6) for _ in range(400)]  # no digits lost at 1.6 x 10^11 rows
    mean, sd = 10**6 / 16, (10**6 / 16 * 15 / 16) ** 0.5
    assert abs(np.mean(draws) - mean) < 5 * sd / 20 and 0.85 < np.std(draws) / sd < 1.15
    m = sharding.communication_matrix([10, 0, 25], [12, 12, 11], 1)
    assert [sum(x) for x in m] == [10, 0, 25] and [sum(c) for c in zip(*m)] == [12, 12, 11]


# Packing and tokenizers


def test_packing_covers_every_id(spark, sample_docs):
    docs = sample_docs.union(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "say <|endoftext|> here", None, None, None)], sample_docs.schema))
    t = Tokenizer.from_file(JSON)
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = rows(packing.pack(docs, JSON, PATTERN, 1))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        own = ids[p["id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and p["doc_tokens"] == len(ids[p["id"]])
        by_doc[p["id"]].append((p["start"], p["length"]))
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(x)
    total = 0
    for x in by_seq.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
        total += at
    assert total / (2048 * len(by_seq)) > 0.95
    assert packing.pack(docs.limit(0), JSON, PATTERN, 1).count() == 0


def test_cut_fills_classes():
    for n in [*range(1, 4200, 7), 2047, 2048, 2049]:
        pieces = packing.cut(n)
        assert sum(p for p, _ in pieces) == n and all(p * k <= 2048 for p, k in pieces)


def test_bpe_equals_tiktoken_and_round_trips(spark, odd, sample_docs):
    ranks = bpe.read_ranks(RANKS)
    enc = tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    alphabet = ["a", "B", " ", "  ", "\n", "'s", "é", "1", "\x1c", "\x85", "漢", "😀", "\t", "\r\n", "²", "abc"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["x" * 900 + "".join(r.choice("abcd") for _ in range(600))]
    texts += [x["text"] for x in sample_docs.limit(60).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is null or doc_id = 3"))
    encoded = bpe.encode(df, RANKS, PATTERN)
    for x in encoded.where("id is not null and id != 3 or size(ids) > 0").collect():
        if x["id"] is not None:
            assert x["ids"] == enc.encode_ordinary(texts[x["id"]])
    back = {x["id"]: bytes(x["bytes"]) for x in bpe.decode(encoded.where("id > 3"), RANKS, PATTERN).collect()}
    assert all(back[i] == t.encode() for i, t in enumerate(texts) if i > 3)
    for x in bpe.round_trip(df, RANKS, PATTERN).where("id > 3").collect():
        ids = enc.encode_ordinary(texts[x["id"]])
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[x["id"]].encode()).hexdigest())
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_bpe_decodes_what_was_encoded():
    e = bpe.SqlBpe(bpe.read_ranks(RANKS), PATTERN)
    (pieces,) = e.texts(["some words here"])
    ids = ",".join(x for x, _ in pieces)
    assert b"".join(x for _, x in pieces) == e.decoded([ids])[0] == b"some words here"
    changed = ",".join([*ids.split(",")[:-1], str(e.byte_id[ord("x")])])  # another identifier, other bytes
    assert e.decoded([changed, ""]) == [b"some wordsx", b""]
    with pytest.raises(Exception, match="unknown identifier"):
        e.decoded(["999999"])
    e.pieces.clear(), e.heads.clear()
    e.db.execute(f"update vocab set hex = '3f' where id = {ids.split(',')[-1]}")  # the bytes come from the vocabulary, not from the text
    (pieces,) = e.texts(["some words here"])
    assert ",".join(x for x, _ in pieces) == ids and b"".join(x for _, x in pieces).endswith(b"?")


def test_bpe_steps_of_long_words():
    ranks = bpe.read_ranks(RANKS)
    e = bpe.engine(RANKS, PATTERN)
    assert e.steps == bpe.ALL  # every token of this vocabulary is made of pairs up to its own rank
    r = random.Random(6)
    words = ["".join(r.choice(a) for _ in range(n)).encode() for a in ("ab", "aaab", "etaoinsh", "0") for n in (5, 40, 150)]
    one = e.stepped(words, bpe.LEFTMOST)
    assert one == e.stepped(words, bpe.ALL) == e.contracted(words)
    enc = tiktoken.Encoding("test", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    assert one == [(",".join(map(str, enc.encode_ordinary(w.decode()))), w) for w in words]
    odd = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"xab": 260, b"xaba": 261}  # xab comes from x and ab, yet ranks below ab
    o = bpe.SqlBpe(odd, PATTERN)
    assert o.steps == bpe.LEFTMOST and o.stepped([b"xabab" * 20], o.steps) == o.contracted([b"xabab" * 20])


LONG_RUNS = [c * 1_000_000 for c in (" ", "\n", "7", ".", "a")] + ["ip 1.1.1." + "1" * 5000, "x" + " " * 300_000 + "y", "+1" + "(" * 100_000, "1-" * 100_000]


def test_long_runs_fail_nothing(spark):
    """Texts of a million equal characters go through the scans, the tokenizers and the pipeline."""
    import corpus_pipeline

    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(LONG_RUNS)], "doc_id long, text string, lang string, source string, n_chars long")
    assert pii.find_pii(df).count() == secret_scan.find_secrets(df).count() == len(LONG_RUNS)
    back = {r["id"]: r["decoded_sha256"] for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    assert back == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(LONG_RUNS)}
    t = Tokenizer.from_file(JSON)
    got = {r["id"]: r["doc_tokens"] for r in packing.pack(df, JSON, PATTERN, 1).select("id", "doc_tokens").distinct().collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(LONG_RUNS)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, "").count() >= 1


def test_packing_deals_hot_classes_in_rounds(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 3000 + [(i, "a " * (i % 50)) for i in range(3000)], "doc_id long, text string").repartition(12)
    got = rows(packing.pack(docs, JSON, PATTERN, 1, group_rows=500))
    seq = defaultdict(list)
    for p in got:
        seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for x in seq.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(p["start"] == 0 for p in got) == 6000 and len(seq) < 1.1 * sum(p["length"] for p in got) / 2048 + 2


@pytest.mark.parametrize("run", [pii.find_pii, secret_scan.find_secrets], ids=["pii", "secrets"])
def test_scans_on_odd_tables(odd, run):
    out = rows(run(odd))
    assert len(out) == odd.count() and Counter(r["id"] for r in out) == Counter(r["doc_id"] for r in odd.collect())
    assert run(odd.limit(0)).count() == 0


def test_sliced():
    texts = ["a" * 600, "é" * 300, None, "", "b" * 5000, "c", None]
    b = pa.RecordBatch.from_arrays([pa.array(range(7), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    assert [p.column(0).to_pylist() for p in sliced(iter([b, b.slice(1, 3)]), 1, 1200)] == [[0, 1, 2, 3], [4], [5, 6], [1, 2, 3]]
    assert [p.column(0).to_pylist() for p in sliced([b], 1, 1)] == [[0], [1], [2, 3], [4], [5, 6]]
    empty = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.nulls(2)], names=["id", "text"])
    assert [p.num_rows for p in sliced([empty, b.slice(0, 0)], 1)] == [2, 0]


@pytest.mark.parametrize("stage", ["language", "digests", "hashes", "sets", "mask", "spans", "pack"])
def test_workers_hold_a_part_of_a_batch(spark, monkeypatch, stage):
    """A batch of 4 MB of text goes through in parts of 1 MB, with the rows that batches of one row give."""
    words = [f"word{i} number {i * 7} of x{i}@y{i}.org" for i in range(4000)]
    texts = [" ".join(words[i * 13 % 300 : i * 13 % 300 + 3600])[:100_000] for i in range(40)]
    df = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *a, f=type(df).mapInArrow: found.append(run) or f(self, run, *a))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    if stage == "language":
        langid.identify(df, model=langid.LanguageModel())
    elif stage == "digests":
        exact_dedup._digested(df)
    elif stage in ("hashes", "sets"):
        minhash._hashed(df, 5, minhash.BANDS, minhash.ROWS) if stage == "hashes" else minhash._sets(df, 5)
    elif stage == "pack":
        packing.pack(df, JSON, PATTERN, 1)
    else:
        pii.mask(df) if stage == "mask" else pii.find_pii(df)
    before = [pa.array([False] * 40)] if stage == "language" else []
    kind = pa.string() if stage in ("language", "mask", "spans", "pack") else pa.binary()
    arrays = [*before, pa.array(range(40), pa.int64()), pa.array([t.encode() for t in texts], pa.binary()).cast(kind)]
    whole = pa.RecordBatch.from_arrays(arrays, names=["held_out", "doc_id", "text"][-len(arrays) :])
    out = list(found[0](iter([whole])))
    assert len(out) >= 4
    assert pa.Table.from_batches(out) == pa.Table.from_batches(list(found[0](whole.slice(i, 1) for i in range(40))))


def test_bpe_and_packing_on_odd_tables(odd):
    assert bpe.round_trip(odd, RANKS, PATTERN).count() == odd.count()
    assert packing.pack(odd, JSON, PATTERN, 1).select("id", "doc_tokens").distinct().count() == odd.selectExpr("doc_id", "coalesce(text, '') t").distinct().count()


# SQL twins and the pipeline


def test_sql_twins(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        assert Counter(map(tuple, df.select(*cols).collect())) == Counter(db.execute(f"select {', '.join(cols)} from ({sql})").fetchall())


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {i: t for i, t in docs.items() if langid.has_letter(t)}
    first = {}
    for i in sorted(docs):
        first.setdefault(exact_dedup.normalised(docs[i].encode()), i)
    docs = {i: docs[i] for i in first.values()}
    docs = {i: docs[i] for i, (_, c) in brute_components(docs, 5, 80).items() if c == i}
    crf = pii.default_model()
    want = {i: pii.masked(t, pii.scan(crf, [t])[0][1]) for i, t in docs.items()}
    t = Tokenizer.from_file(JSON)
    got = defaultdict(int)
    for p in corpus_pipeline.run(spark, sf).collect():
        got[p["doc_id"]] += p["length"]
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"] and json.dumps(corpus_pipeline.ORACLE_SQL) == "null"


def test_pipeline_stages_keep_columns_and_take_odd_rows(spark, odd):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
