"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterforest.llm import backoff, cover_tree, html_extract, jaccard, licenses, mixing, packing, projection_search, suffixes, toxicity
from rasterforest.llm.queries import ORACLES, tokenizer_path

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = sentence(120)
TEXTS = [BASE, BASE, BASE.upper(), BASE.replace("w7 ", "x7 ", 1), BASE + " tail of it", sentence(120), "a b c d e f g", "a b c d e f g", "one two", "One two", "", "  \n\t", None, sentence(2500), "same same same same same same", sentence(30) + " " + BASE[:260] + " " + sentence(30), "x" * 450, "é" * 150 + BASE[:230]]
ODD = "doc_id long, text string, source string, lang string, n_chars long, size long, score double, component_id long, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 3 else f"s{i % 3}", "en", 0, -1, -1.0, -1, "no") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def loose(spark, docs):
    """With a null id and a repeated row."""
    return docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))


def oracle(sql, docs, labels=None):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    con.register("labels", labels.toArrow() if labels is not None else duckdb.sql("SELECT 0::BIGINT AS doc_id, 1 AS quality WHERE false").df())
    return con.sql(sql)


def same(df, relation, places=6):
    names = sorted(df.columns)
    row = lambda r: tuple(round(float(x), places) if isinstance(x, float) else x for x in r)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((row(r) for r in df.select(*names).collect()), key=key)
    want = sorted((row(r) for r in relation.select(*[f'"{n}"' for n in names]).fetchall()), key=key)
    assert got == want


def test_backoff(docs, loose, empty):
    for table in (docs, loose):
        got = backoff.backoff_scores(table, block_bytes=500).withColumn("score", F.round("score", 6))
        same(got, oracle(backoff.ORACLE, table), 5)
    assert backoff.backoff_scores(empty).count() == 0


def test_packing(loose, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    limits = packing.Limits(tokens=256, segments=6, loss=256, block_tokens=3000)
    pieces = packing.pack_documents(loose.coalesce(1), tokenizer_path(), limits=limits).toPandas()
    ids = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for r in loose.collect()}
    for doc_id, part in pieces[pieces.doc_id.notna() & (pieces.doc_id != 0)].groupby("doc_id"):
        part = part.sort_values("start")
        assert b"".join(part.tokens) == ids[doc_id] and part.start.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = s.length.sum()
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and total <= 256 and len(s) <= 6
        assert total == 256 or total & (total - 1) == 0
    assert pieces.length.sum() == sum(len(ids[r["doc_id"]]) // 4 for r in loose.select("doc_id").collect())
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_ids_of_odd_texts(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|ENDOFTEXT|> b", "x <|endoftext|> y", "<|Endoftext|>", "don't, it's. (so)... \t tab\n\nx.", "İstanbul ΣΑΣ. é end, word.", "A\u00a0B\u0085C, d.\x1c e", "Ünïcode wörds, CAPS. 12.5%", " ", "漢字 и слова, да."]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, tokens string").coalesce(1)
    got = packing.pack_documents(df, tokenizer_path(), limits=packing.Limits(tokens=8, segments=3, loss=8)).orderBy("doc_id", "start").toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        assert b"".join(got[got.doc_id == i].tokens) == ids and (got[got.doc_id == i].doc_tokens == len(ids) // 4).all()
    # Texts beyond a part are cut at white space; a word beyond it stays whole.
    parts = packing.cut_long("aa bb ccccccccc dd", 6)
    assert "".join(parts) == "aa bb ccccccccc dd" and parts[1:] == [" ccccccccc", " dd"]


def test_long_texts_in_parts(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART_BYTES", 50)
    texts = [sentence(40) + ", Some. " + sentence(9), "x" * 300, "", sentence(3)] * 3
    encode, got = packing.Encoder(tokenizer_path(), known_bytes=400), []
    for _, ids, sizes in packing.encoded(packing.pa.array(texts), encode):
        got += [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]
    whole = Tokenizer.from_file(tokenizer_path())
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_many_short_pieces():
    began = time.time()
    bins = packing.pack_cutting(np.ones(100_000, dtype=np.int64), packing.Limits())
    assert sum(n for b in bins for *_, n in b) == 100_000 and max(map(len, bins)) <= 512
    assert time.time() - began < 10


def test_conversations(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    count = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    turns = [(c, t, "assistant" if t % 2 else "user", sentence(5 + c)) for c in range(30) for t in range(4)] + [(3, 4, "assistant", None), (3, 4, "assistant", None), (None, 0, None, "no id"), (77, 0, "assistant", "")]
    df = spark.createDataFrame([(*t, -1) for t in turns], "conv_id long, turn long, role string, text string, n_tokens int")
    examples = {r["example_id"]: (r["n_tokens"], r["n_loss"]) for r in packing.instruction_examples(df, tokenizer_path()).collect()}
    want = {}
    for c, _, role, text in turns:
        a, b = want.get(c, (0, 0))
        want[c] = (a + count(text), b + (count(text) if role == "assistant" else 0))
    assert examples == want
    got = packing.pack_examples(packing.instruction_examples(df, tokenizer_path()).coalesce(1), packing.Limits(tokens=300, segments=4, loss=120)).toPandas()
    assert len(got) == len(want) and got.example_id.isna().sum() == 1
    for _, s in got.groupby("sequence_id"):
        assert len(s) == 1 or (s.n_tokens.sum() <= 300 and s.n_loss.sum() <= 120 and len(s) <= 4)
    assert packing.pack_examples(packing.instruction_examples(df.limit(0), tokenizer_path())).count() == 0


def test_packing_whole_examples(spark):
    rows = [(i, RNG.randrange(1, 90), 0) for i in range(80)] + [(99, 500, 3), (None, None, None)]
    df = spark.createDataFrame([(i, n, n and n // 2) for i, n, _ in rows], "example_id long, n_tokens long, n_loss long").coalesce(1)
    got = packing.pack_examples(df, packing.Limits(tokens=100, segments=4, loss=45)).toPandas()
    assert len(got) == 82
    for _, s in got.groupby("sequence_id"):
        assert len(s) == 1 or (s.n_tokens.sum() <= 100 and s.n_loss.sum() <= 45 and len(s) <= 4)
    assert got.sequence_id.nunique() < 60


VECTORS = "vec_id long, embedding array<float>, vector string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    points = [*rng.standard_normal((300, 6)).tolist(), *[[0.5] * 6] * 40]
    rows = [(i, p, "clash") for i, p in enumerate(points)] + [(900, None, ""), (901, [None, *[1.0] * 5], ""), (902, [float("nan")] * 6, ""), (903, [float("inf")] * 6, ""), (904, [], ""), (905, [0.0] * 6, "")]
    return spark.createDataFrame(rows, VECTORS)


def best(points, q, k, measure):
    return sorted(((measure(points[q], p), i) for i, p in points.items() if i != q))[:k]


def test_inner_products(vectors):
    scaled = cover_tree.scaled(vectors)
    points = {r["vec_id"]: np.array(r["vector"]) for r in scaled.collect()}
    assert set(points) == {*range(340), 905}
    got = cover_tree.top_inner_products(scaled.where("vec_id % 50 = 0"), scaled, 5, rows_per_block=64).orderBy("query_id", "rank").collect()
    want = [(q, n + 1, i, -s) for q in sorted(p for p in points if p % 50 == 0) for n, (s, i) in enumerate(best(points, q, 5, lambda a, b: -int(a @ b)))]
    assert [tuple(r) for r in got] == want
    few = cover_tree.top_inner_products(scaled.where("vec_id = 0"), scaled.where("vec_id < 3"), 5)
    assert few.count() == 2 and cover_tree.top_inner_products(scaled.limit(0), scaled, 5).count() == 0
    assert cover_tree.top_inner_products(scaled, scaled.limit(0), 5).count() == 0


def test_inner_products_of_repeats_and_lengths(spark):
    """Repeated rows count each, none of a query's own id; lengths don't meet; null ids take no part; large numbers are refused."""
    rows = [(1, [1.0, 0.0]), (1, [9.0, 9.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [2.0, 5.0]), (4, [7.0, 7.0, 7.0]), (None, [8.0, 8.0])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = cover_tree.top_inner_products(v.where("vec_id IN (2, 4)").distinct(), v, 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(2, 1, 1, 36), (2, 2, 3, 11), (2, 3, 1, 3)]
    got = cover_tree.top_inner_products(v.where("vec_id = 3"), v, 3).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(3, 1, 1, 63), (3, 2, 2, 11), (3, 3, 2, 11)]


def test_inner_products_of_large_components(spark):
    """Sums that doubles would round, scores that differ by one beyond 2**53, and ends of the range."""
    rng = np.random.default_rng(9)
    rows = [[float(x) for x in rng.integers(-100, 100, 3)] for _ in range(40)]
    rows += [[float(2**30 + i), float(-(2**29)), float(i)] for i in range(6)] + [rows[3], [1e18, 1e18, 0.0], [-1e18, 0.0, 0.0]]
    points = {i: [int(x) for x in r] for i, r in enumerate(rows)}
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, vector array<double>")
    got = [tuple(r) for r in cover_tree.top_inner_products(df.where("vec_id % 3 = 0 OR vec_id > 40"), df, 4, rows_per_block=8).orderBy("query_id", "rank").collect()]
    last = 2**63 - 1
    dot = lambda a, b: max(-last, min(last, sum(x * y for x, y in zip(a, b))))
    want = [(q, n + 1, i, -s) for q in points if q % 3 == 0 or q > 40 for n, (s, i) in enumerate(best(points, q, 4, lambda a, b: -dot(a, b)))]
    assert got == want


def test_blocks_are_the_same_on_every_layout(spark):
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(clusters(900, 12, 4))], "vec_id long, vector array<double>")
    one, many = (projection_search.nearest_neighbours(x.where("vec_id % 30 = 0"), x, 5, m=4, rows_per_block=64) for x in (v.coalesce(1), v.repartition(7)))
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((40, dim)) * 4
    return middles[rng.integers(0, 40, n)] + rng.standard_normal((n, dim)) * 0.3


def test_cover_tree_prunes():
    points = np.floor(clusters(2000, 32, 5) * 256)
    tree = cover_tree.cover_tree(points)
    todo, seen = [tree], 0
    while todo:
        node = todo.pop()
        assert np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        assert all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        seen += 0 if node.children else len(node.rows)
        todo += node.children
    assert seen == 2000 and tree.children
    queries = points[::50]
    best = cover_tree.dual_search(queries, points, tree, 5, lambda i, j: i[:, None] * 50 == j, np.full(40, -np.inf))
    scores = queries @ points.T
    scores[np.arange(40), np.arange(40) * 50] = -np.inf
    assert (best.scores == -np.sort(-scores, axis=1)[:, :5]).all()
    assert best.scored < 0.3 * scores.size


@pytest.mark.parametrize("spread, share", [("clusters", 0.2), ("sphere", 0.95)])
def test_chi_square_stop(spread, share):
    """Recall and verified share at the registered query's setting."""
    points = clusters(4000, 64, 6) if spread == "clusters" else np.random.default_rng(6).standard_normal((4000, 64))
    if spread == "sphere":
        points /= np.sqrt((points**2).sum(axis=1))[:, None]
    index = projection_search.ProjectedIndex(points, projection_search.projection(64, 16, 7))
    limit, hits = projection_search.chi_square_quantile(0.95, 16), 0
    for q in range(0, 4000, 100):
        rows, _ = index.nearest(points[q], 10, np.array([q]), limit)
        gaps = ((points - points[q]) ** 2).sum(axis=1)
        gaps[q] = np.inf
        hits += len({*np.argsort(gaps)[:10]} & {*rows})
    assert hits / 400 >= 0.9
    assert index.verified / (40 * 4000) < share


def test_neighbours_of_repeats(spark):
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.5]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [5.0, 5.0]), (4, [1.0] * 4), (None, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = projection_search.nearest_neighbours(v.where("vec_id IN (3, 4)"), v, 10, m=2).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(3, 2), (3, 2), (3, 1), (3, 1)]
    assert projection_search.nearest_neighbours(v, v.limit(0), 3).count() == 0


def test_neighbours(vectors):
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    points = {r["vec_id"]: np.array(r["vector"]) for r in v.where("vec_id < 340").collect()}
    got = projection_search.nearest_neighbours(v.where("vec_id % 20 = 0"), v, 10, m=4, rows_per_block=64).toPandas()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        want = best(points, q, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())))
        total += 10
        hits += len({i for _, i in want} & set(part.vec_id))
        assert part.sort_values("rank").score.is_monotonic_increasing
        if q >= 300:  # equal points: ties to the smaller id
            assert part.sort_values("rank").vec_id.tolist() == [i for _, i in want]
    assert hits / total >= 0.9
    assert projection_search.chi_square_cdf(projection_search.chi_square_quantile(0.9, 8), 8) == pytest.approx(0.9)


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(WORDS) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[5], words[20] = rng.choice(["badword", "stemming", "stemless", "BADW0RD"]), "stemful"
        elif i % 3 == 1:
            words[7:9] = ["fine", "badword"]
        rows.append((i, " ".join(words), "x"))
        marks.append((i, int(toxic), 1))
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lexicon = toxicity.learn(texts, spark.createDataFrame(marks, "doc_id long, toxic int, quality int"))
    got = toxicity.score_toxicity(texts, lexicon).toPandas()
    held = got[got.held_out]
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert ((held.predicted == 1) == (held.doc_id % 3 == 0)).mean() > 0.95
    assert toxicity.folded("1D10T, bаd—Sтuff!") == toxicity.folded("idiot bad stuff")
    assert toxicity.folded(None) == toxicity.folded(" \n") == " "
    spared = toxicity.Lexicon({" trash ": 5.0}, frozenset({" trash can "})).compiled()
    assert spared.features(toxicity.folded("a trash can"))[1] == 0 and spared.features(toxicity.folded("trash can trash"))[1] == 1
    terms = {" bad ": 2.0, " ba": 1.0, " badly ": 3.0, " trash ": 5.0}
    phrases = frozenset({" trash can ", " can bad ", " very bad "})
    compiled = toxicity.Lexicon(terms, phrases).compiled()
    for _ in range(200):
        text = f" {' '.join(rng.choice(['bad', 'badly', 'trash', 'can', 'very', 'base', 'no']) for _ in range(12))} "
        found = {}
        for start in range(len(text)):
            held = [(w, t) for t, w in terms.items() if text.startswith(t, start)]
            spans = [(i, i + len(p) - 1) for p in phrases for i in range(len(text)) if text.startswith(p, i)]
            if held and not any(a <= start < b for a, b in spans):
                found[start] = max(held)
        assert compiled.hits(text) == found
    assert toxicity.folded("𝐁𝐀𝐃 𝔹𝟘𝕆") == toxicity.folded("bad boo") and toxicity.folded("ԁо9 gгɡ") == toxicity.folded("dog grg")
    # A task without rows of the sample, null ids, repeats and a very long text.
    wide = texts.where("doc_id < 60").unionByName(texts.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(texts.where("doc_id = 1")).repartition(40)
    toxicity.learn(wide, spark.createDataFrame(marks, "doc_id long, toxic int, quality int"))
    twice = toxicity.score_toxicity(wide, lexicon).toPandas()
    assert len(twice) == 62 and not twice[twice.doc_id.isna()].held_out.any() and twice[twice.doc_id == 1].score.nunique() == 1
    long = spark.createDataFrame([(1, "fine words " * 300_000 + "stemful " * 50_000)], "doc_id long, text string")
    assert toxicity.score_toxicity(long, lexicon).first()["predicted"] == 1
    odd = toxicity.score_toxicity(docs, lexicon).toPandas()
    assert len(odd) == len(TEXTS) and odd.score.between(0, 1).all()
    assert toxicity.score_toxicity(empty, lexicon).count() == 0
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, nothing).where("predicted = 1").count() == 0


def test_mixing(spark, docs, loose, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 0), (13, None), (77, 1)], "doc_id long, quality int")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    for table in (docs, loose):
        got = mixing.mix(table, mixing.label_quality(labels), rows_per_range=2).select(cols)
        same(got, oracle(mixing.ORACLE, table, labels))
    parts = got.toPandas()
    assert (parts.taken <= 2 * parts["size"]).all()
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs)
    words = mixing.apply_mix(docs, mixed)
    assert words.columns == docs.columns
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in words.collect())
    assert total == mixed.agg(F.sum("taken")).first()[0]


def test_mixing_deals_keys_of_all_weights_evenly(spark):
    rows = spark.range(20_000).select("id", F.lit("s").alias("source"), F.element_at(F.array(*map(F.lit, (0.01, 0.5, 1.0, 1.9, 30.0))), (F.col("id") % 5 + 1).cast("int")).alias("weight"))
    rows = rows.withColumn("key", -F.log(mixing.uniform(F.col("id"), 42)) / F.col("weight"))
    dealt = rows.join(mixing.weight_classes(rows), "source").withColumns({"n_docs": F.lit(20_000), "ranges": F.lit(100)})
    sizes = dealt.groupBy(mixing.key_range().alias("range")).agg(F.count("id").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("range").toPandas()
    assert sizes.n.max() < 2.5 * 200 and len(sizes) > 60
    assert (sizes.high.to_numpy()[:-1] < sizes.low.to_numpy()[1:]).all()


def linked(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard(spark, docs, loose, empty):
    texts = dict(enumerate(TEXTS))
    # Sizes around band edges, chains of small changes, and texts at exactly the threshold.
    for k in range(40):
        w = sentence(6 + k).split()
        texts[100 + 4 * k] = " ".join(w)
        w[RNG.randrange(len(w))] = "new"
        texts[101 + 4 * k] = " ".join(w)
        texts[102 + 4 * k] = " ".join(w[1:])
        texts[103 + 4 * k] = " ".join([*w, "end"])
    chain = sentence(150).split()
    for k in range(25):
        chain[6 * k] = f"c{k}"
        texts[400 + k] = " ".join(chain)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for n, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n, percent).collect()}
        assert got == linked(texts, n, percent)
    kept = jaccard.keep_representatives(docs, jaccard.jaccard_components(docs))
    assert kept.columns == docs.columns and kept.where("doc_id IN (1, 2)").count() == 0
    out = jaccard.jaccard_components(loose)
    assert out.count() == loose.count() and out.where("doc_id IS NULL AND component_id IS NULL").count() == 1
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_of_long_texts_with_frequent_passages(spark, n, percent):
    # Sets of more than a thousand shingles that hold the same passages, with near copies at and around the threshold.
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(60)] for _ in range(4)]
    texts = []
    for i in range(24):
        words = [word() for _ in range(1500)] + [w for p in passages for w in p]
        texts.append(" ".join(words))
        for share in ((0.01, 0.016, 0.02, 0.024, 0.03, 0.04, 0.05) if i < 8 else ()):
            texts.append(" ".join(word() if rng.random() < share else w for w in words[: rng.randint(1600, len(words))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, n, percent).collect()}
    assert got == linked(dict(enumerate(texts)), n, percent) and 24 < len({c for _, c in got.values()}) < len(texts)


def test_jaccard_of_large_ids(spark):
    words, big = sentence(200).split(), 2**62
    near = " ".join([*words[:100], "other", *words[101:]])
    df = spark.createDataFrame([(big + 1, " ".join(words)), (big + 3, near), (None, "x"), (big + 5, sentence(90))], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert got == {big + 1: big + 1, big + 3: big + 1, big + 5: big + 5, None: None}
    assert jaccard.distinct_documents(df).count() == 3


def test_jaccard_null_id_copy_first(spark):
    words = sentence(200).split()
    near = " ".join([*words[:100], "other", *words[101:]])
    df = spark.createDataFrame([(None, " ".join(words)), (5, " ".join(words)), (7, near), (None, near)], "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard.jaccard_components(df).collect())
    assert got == [(0, None), (0, None), (5, 5), (7, 5)]


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.GROUP_CONTEXTS, 1])
def test_suffixes(loose, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "GROUP_CONTEXTS", hot)
    for length in (200, 64):
        done = suffixes.remove_repeats(loose, length)
        assert done.columns == [*[c for c in loose.columns if c != "spans"], "n_bytes", "spans", "kept"]
        got = [(r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in done.collect()]
        assert sorted(got) == sorted(without_repeats([r["text"] for r in loose.collect()], length))
    assert suffixes.remove_repeats(empty).count() == 0


def test_licenses(spark, docs, empty):
    texts = ["Licensed under CC BY-NC 4.0.", "intro\nLICENCED under the MIT licence!\nmore", "Copyright (c) 2020 Someone\nLicensed under the MIT License", "Licensed under nothing", None, "", "All rights reserved.\nlicensed under Creative Commons Attribution-NonCommercial 4.0", "Released  under the MIT License"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert got[0]["whole_license"] == "CC-BY-NC-4.0" and got[1]["licenses"] == "MIT" and got[1]["whole_license"] is None
    assert got[2]["whole_license"] == "MIT" and got[3]["licenses"] == "" and got[6]["n_license_lines"] == 2
    con = duckdb.connect()
    for table in (df, docs):
        con.register("documents", table.select("doc_id", "text").toArrow())
        same(licenses.scan_licenses(table), con.sql(ORACLES["op8_licenses"]))
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_in_other_spellings(spark):
    texts = {
        "Released under Creative Commons Attribution 4.0 International.": "CC-BY-4.0",
        "Released under CC BY 4.0.": "CC-BY-4.0",
        "Released under CC0 1.0.": "CC0-1.0",
        "Released under the GPL, version 3.": "GPL-3.0-only",
        "Released under cc by nc v4.0": "CC-BY-NC-4.0",
    }
    rows = list(enumerate(texts)) + [(10 + i, f"first\n{t}\n\nCopyright 2020 x") for i, t in enumerate(texts)] + [(99, "Copyright 2020 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, name in enumerate(texts.values()):
        assert (got[i]["whole_license"], got[i]["n_lines"], got[i]["n_license_lines"], got[i]["licenses"]) == (name, 1, 1, name)
        assert (got[10 + i]["whole_license"], got[10 + i]["n_lines"], got[10 + i]["n_license_lines"], got[10 + i]["licenses"]) == (None, 4, 1, name)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    same(licenses.scan_licenses(df), con.sql(ORACLES["op8_licenses"]))


def test_spellings_as_without_their_strings(spark):
    # Each rule is skipped only for texts that it can't change.
    rng = random.Random(8)
    parts = ["Creative Commons", "Attribution", "non-commercial", "NonCommercial", "no-derivs", "NoDerivatives", "share-alike", "ShareAlike", "GNU General Public License", "GNU Lesser General Public License", "gnu affero general public license", "Mozilla Public License", "licence", "licenced", "licences", "version 2", "v3", "v. 4", "international", "the", "a", "license", "released", "\nCopyright (c) x\n", "\n(C) y\n", "\n\u00a9 z\n", "re", "s", "-", "."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + [None, ""]
    plain = F.regexp_replace(F.lower("text"), licenses.COPYRIGHT, "")
    for pattern, to, _ in licenses.SPELLINGS:
        plain = F.regexp_replace(plain, pattern, to)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(~licenses.spelled(F.col("text")).eqNullSafe(plain)).count() == 0


def test_license_texts(spark):
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    texts = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0-only"} <= set(texts)
    names = sorted(texts)
    rows = [(i, texts[n]) for i, n in enumerate(names)]
    rows += [(100 + i, f"# tool\nintro of it\n\n{texts[n]}\nthe end") for i, n in enumerate(names)]
    mit = texts["MIT"].strip()
    rows += [(200, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + mit), (201, " ".join(mit.split())), (202, f"{mit}\nLicensed under CC BY 4.0.\n{mit}\n"), (203, mit.replace("merge", "sell"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, n in enumerate(names):
        assert got[i]["whole_license"] == n and n in got[i]["licenses"].split(",")
        assert got[100 + i]["whole_license"] is None and n in got[100 + i]["licenses"].split(",") and got[100 + i]["n_license_lines"] > 5
    filled = sum(bool(x.strip()) for x in mit.split("\n"))
    assert (got[200]["whole_license"], got[200]["n_license_lines"]) == ("MIT", filled)
    assert (got[201]["whole_license"], got[201]["n_license_lines"]) == ("MIT", 1)
    assert (got[202]["whole_license"], got[202]["n_license_lines"], got[202]["licenses"]) == (None, 2 * filled + 1, "CC-BY-4.0,MIT")
    assert (got[203]["whole_license"], got[203]["n_license_lines"], got[203]["licenses"]) == (None, 0, "")


PAGE = "<html><head><title>{t}</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><article><h1>{t}</h1><p>{a}<p>{b} &amp; more</article><footer>&copy; us</footer></body></html>"


def test_html(spark):
    rows = [(i, f"u{i}", PAGE.format(t=sentence(5), a=sentence(30) + ".", b=sentence(20) + ".")) for i in range(60)]
    odd = [(100, "u", None), (101, "u", ""), (102, "u", "<div><p>unclosed &lt; tag <b"), (103, "u", "plain text only"), (104, "u", "<script>" * 50), (0, "u0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows + odd], "page_id long, url string, html string, text string, n_chars int")
    chain = html_extract.fit(pages, sample=60)
    got = html_extract.extract(pages, chain).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r["n_chars"] == len(r["text"])
        if r["page_id"] < 60:
            source = rows[r["page_id"]][2]
            title, first, second = re.search("<h1>(.*?)</h1><p>(.*?)<p>(.*?) &amp; more", source).groups()
            assert r["text"] == f"{title}\n{first}\n{second} & more"
    assert {r["page_id"]: r["text"] for r in got}[100] == ""
    hard = '<div id="menu"><ul><li><a href=1>Home</a></ul></div><div class="cookie-notice"><p>We use cookies here.</p></div><div class="post-body"><h1>Title of it</h1><p>First <b>part</b> of the text, and more of it here.</p><div class="ad">Buy this now.</div><p>Second part of the text follows.</p></div><section id="comments"><p>Nice text, thanks a lot.</p></section>'
    blocks = html_extract.leaves(hard)
    kept = [b.text for b, s in zip(blocks, chain.viterbi(html_extract.features(blocks))) if s]
    assert kept == ["Title of it", "First part of the text, and more of it here.", "Second part of the text follows."]
    assert html_extract.extract(pages.limit(0), chain).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        rows = [[f"f{j}" for j in rng.integers(0, 5, 2)] for _ in range(5)]
        chain = html_extract.Chain({f"f{j}": float(w) for j, w in enumerate(rng.normal(size=5))}, tuple(rng.normal(size=4)), tuple(rng.normal(size=2)))
        e, steps = chain.potentials(rows), np.array(chain.steps).reshape(2, 2)
        value = lambda y: chain.first[y[0]] + sum(e[i, s] for i, s in enumerate(y)) + sum(steps[a, b] for a, b in zip(y, y[1:]))
        every = [[(k >> i) & 1 for i in range(5)] for k in range(32)]
        assert value(chain.viterbi(rows)) == pytest.approx(max(map(value, every)))
