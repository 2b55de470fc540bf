"""Operators against plain versions, on hand-made odd tables and on the small tables."""

import gzip
import random
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corvane.llm import decontaminate, jaccard_join, license_scan, lm_score, packing, quality, repair_store, topk_search, viterbi_count, warc
from corvane.llm import queries as llm

SF = f"{DATA}/sf0.001"
ODD = brute.odd_rows()


def small(name):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def rows():
    return small("documents")


@pytest.fixture(scope="module")
def odd(spark):
    return brute.documents(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.documents(spark, [])


LICENCE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_licences(spark, odd, none, rows):
    assert brute.collected(license_scan.scan(odd), *LICENCE) == brute.licences(ODD)
    assert license_scan.scan(none).count() == 0
    assert brute.collected(llm.op1_license_scan(spark, SF), *LICENCE) == brute.licences(rows)


@pytest.mark.parametrize(
    ("text", "labels"),
    [(b"released under the mit licence", {"mit"}), (b"permission is hereby granted fre of charge", {"mit"}), (b"all right reserved", {"reserved"}), (b"the committee mitigates", set()), (b"Mozilla-Public/License", {"mpl"})],
)
def test_fuzzy_notices(text, labels):
    assert {f[0] for f in license_scan.scan_text(text)[2]} == labels


@pytest.mark.parametrize("seed", range(4))
def test_seeds_find_every_notice_within_its_edits(seed):
    """Notices edited at random are found, wherever the edits fall."""
    rng = random.Random(seed)
    for notice in license_scan.NOTICES:
        chars = list(notice.phrase)
        for _ in range(notice.edits):
            k = rng.randrange(1, len(chars) - 1)
            if rng.random() < 0.5:
                chars[k] = rng.choice("qxz")
            else:
                del chars[k]
        text = "some words before " + "".join(chars) + " and after"
        assert notice.label in {f[0] for f in license_scan.scan_text(text.encode())[2]}, text


def test_notices_from_a_table(spark):
    table = spark.createDataFrame([("House Rules, Apply", "house", 2, True), ("...", "none", 0, False), (None, "none", 0, False)], "phrase string, label string, edits int, base boolean")
    notices = license_scan.notices_from(table)
    assert [n.phrase for n in notices] == ["house rules apply"]
    docs = spark.createDataFrame([(1, "here house-rules apply."), (2, "hous rule apply")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["labels"]) for r in license_scan.scan(docs, notices).collect()}
    assert got == {1: (1, 1, "house"), 2: (0, None, "house")}
    with pytest.raises(ValueError):
        license_scan.notices_from(table, most=1)


DIGEST = ("doc_id", "start", "n_tokens", "ids_crc32")


def test_token_files(spark, odd, none, rows):
    assert brute.collected(repair_store.read_digests(repair_store.write(odd, shard_tokens=5_000)), *DIGEST) == brute.token_digests(ODD)
    assert repair_store.read_digests(repair_store.write(none)).count() == 0
    assert brute.collected(llm.op3_repair_tokens(spark, SF), *DIGEST) == brute.token_digests(rows)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.zipf(1.3, n) % 50 for n in (0, 1, 2, 5_000, 300, 0, 40_000)] + [np.zeros(999, int)]
    flat, bounds = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    shard = repair_store.Shard.from_bytes(repair_store.Shard.of(np.arange(len(docs)), flat, bounds, 50_257).to_bytes())
    assert len(shard.rules) > 100 and len(shard.symbols) < 0.7 * len(flat)
    assert (shard.expand(shard.symbols) == flat).all()
    for k, d in enumerate(docs):
        assert (shard.document(k) == d).all()
        for low, high in ((0, 1), (len(d) // 3, len(d) // 2), (len(d) - 1, len(d) + 5)):
            low = max(0, low)
            assert (shard.document(k, low, high) == d[low:high]).all()


def test_repair_repeats_until_no_pair_is_frequent():
    """Long repeats, runs of one id and more rules than two bytes can name; ids beyond the first nonterminal are refused."""
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 40_000, 500)
    wide = np.concatenate([np.repeat(np.stack([np.arange(18_000) * 2, np.arange(18_000) * 2 + 1], 1), 16, axis=0).reshape(-1)])
    for docs, first in (([np.concatenate([passage, rng.integers(0, 40_000, 7)]) for _ in range(40)], 50_257), ([np.zeros(9_999, int), np.tile([1, 2], 800)], 50_257), ([wide], 50_257)):
        flat, bounds = np.concatenate(docs).astype(np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        shard = repair_store.Shard.from_bytes(repair_store.Shard.of(np.arange(len(docs)), flat, bounds, first).to_bytes())
        assert (shard.expand(shard.symbols) == flat).all()
        pairs = Counter(p for low, high in zip(shard.symbol_bounds[:-1], shard.symbol_bounds[1:]) for p in zip(shard.symbols[low:high].tolist(), shard.symbols[low + 1 : high].tolist()))
        assert max(pairs.values(), default=0) < 16
    assert len(shard.rules) >= 18_000  # more than two bytes can name
    with pytest.raises(ValueError):
        repair_store.compress(np.array([7, 70_000]), np.array([0, 2]), 50_257)


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark, odd, none, rows):
    long = " ".join(brute.PROSE)
    items = [("b", long), ("a", "three"), ("a", "two three"), ("c", None), ("d", ""), (None, "all rights reserved"), ("e", long)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.find(odd, bench)
    assert brute.collected(got, *CONTAMINATION) == brute.contamination(ODD, items)
    kept = decontaminate.keep_clean(odd, bench)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not r[-1] for r in brute.contamination(ODD, items))
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(odd, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = brute.contamination(rows, [(str(i), t) for i, t in items])
    assert brute.collected(llm.op4_fm_index_decontamination(spark, SF), *CONTAMINATION) == want and any(r[-1] for r in want)


def test_decontamination_of_very_long_texts_by_several_blocks(spark):
    """A text of many shards, windows across their borders, and a benchmark of several block files."""
    rng = random.Random(3)
    long = [f"w{rng.randrange(5_000)}" for _ in range(300_000)]
    items = [(str(k), " ".join(long[at : at + 30])) for k, at in enumerate((0, 980, 995, 1_990, 150_000, 299_970))]
    items += [(f"x{k}", " ".join(f"y{rng.randrange(5_000)}" for _ in range(40))) for k in range(200)] + [("short", "y1 y2"), ("one", long[77])]
    rows = [(1, " ".join(long)), (2, " ".join(long[985:1_040])), (3, "y1 y2 " * 5), (4, items[10][1] + " z " + items[11][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert len(decontaminate.phrase_blocks(bench, block_bytes=4_000)) > 3
    want = brute.contamination(rows, items)
    for words in (1_000, 70_000, 500_000):
        assert brute.collected(decontaminate.find(docs, bench, shard_words=words, block_bytes=4_000), *CONTAMINATION) == want


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(2)
    sizes = np.array([0, 3, 200, 1, 0, 500])
    numbers = rng.integers(0, 3, sizes.sum())
    index = decontaminate.FMIndex([b"a", b"b", b"c"], numbers, sizes)
    starts = np.cumsum(sizes) - sizes
    for pattern in ([0], [1, 2], [2, 2, 0], [0, 1, 0, 1, 2], [1] * 9):
        low, high = index.search(np.array([pattern]) + 1, np.array([len(pattern)]))
        found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        want = [int(index.starts[d] + k) for d in range(len(sizes)) for k in range(sizes[d] - len(pattern) + 1) if numbers[starts[d] + k : starts[d] + k + len(pattern)].tolist() == pattern]
        assert found == want


def test_counts_equal_the_unigram_tokenizer(odd, none, rows):
    """The tokenizers library's own unigram model, on the same pieces and probabilities, over whole texts without a split."""
    import pyarrow as pa
    from tokenizers import Tokenizer, models, normalizers

    pieces = viterbi_count.vocabulary(brute.public_tokenizers.path(viterbi_count.VOCABULARY))
    assert sum(np.exp(s) for _, s in pieces) == pytest.approx(1)
    least = min(s for _, s in pieces)
    plain = Tokenizer(models.Unigram([("<unk>", least), *((f"<0x{k:02X}>", least) for k in range(256)), *pieces], unk_id=0, byte_fallback=True))
    plain.normalizer = normalizers.Replace(" ", viterbi_count.MARK)
    whole = lambda t: t if t[0] in " " + viterbi_count.MARK else " " + t
    texts = [t for _, t in ODD if t] + [t for _, t in rows if t] + ["  two  spaces   three", " " * 50, "x" + " " * 17 + "y▁▁ ▁z", "\t\n  \n", "ab" * 3_000]
    tool = viterbi_count.Counter(pieces)
    got, _ = tool.column(pa.array(texts, pa.string()))
    assert got.tolist() == [len(plain.encode(whole(t), add_special_tokens=False).ids) for t in texts]
    assert tool.word("▁" * 16)[0] == 1
    # Control and byte pieces are text like any other.
    assert tool.word("▁<s>")[0] > 1 and tool.word("▁<0x41>")[0] > 1
    counted = {r["doc_id"]: r["n_tokens"] for r in viterbi_count.count(odd).collect()}
    assert counted[1] == 0 and counted[2] == 0 and viterbi_count.count(none).count() == 0


def test_counts_of_a_very_long_word(spark):
    """Memory stays with the text's own size; the path is that of the parts between certain cuts."""
    import tracemalloc

    tool = viterbi_count.counter(brute.public_tokenizers.path(viterbi_count.VOCABULARY))
    one, _ = tool.word("abcde漢" * 1_000)
    tracemalloc.start()
    many, _ = tool.word("abcde漢" * 10_000)
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()
    assert 9 * one < many < 11 * one


GROUPS = ("doc_id", "n_shingles", "component_id")


def test_jaccard_groups(spark, odd, none, rows):
    assert brute.collected(jaccard_join.join_components(odd), *GROUPS) == brute.components(ODD)
    assert jaccard_join.join_components(none).count() == 0
    assert brute.collected(llm.op6_partenum_jaccard(spark, SF), *GROUPS) == brute.components(rows)


def test_jaccard_links_rows_without_an_id(spark):
    base = " ".join(brute.PROSE * 3)
    rows = [(1, base), (2, "something else altogether in here"), (None, base + " word"), (None, base + " word"), (3, base + " word more"), (4, None), (None, "x y z"), (None, "x y z")]
    docs = brute.documents(spark, rows)
    got = brute.collected(jaccard_join.join_components(docs), *GROUPS)
    assert got == brute.components(rows) and [g[2] for g in got if g[0] is None].count(1) == 2
    kept = sorted(((r["doc_id"] or 0, r["text"] or "") for r in jaccard_join.keep_one(docs).collect()))
    assert kept == [(0, "x y z"), (1, base), (2, rows[1][1]), (4, "")]


def test_jaccard_keeps_one(odd):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(i, t) for (i, t), (_, n, c) in ((r, next(w for w in brute.components(ODD) if w[0] == r[0] and w[1] == len(brute.shingles(r[1])))) for r in ODD) if n == 0 or i == c]
    assert brute.in_order(got) == brute.in_order([x for k, x in enumerate(want) if x[1] is None or not brute.shingles(x[1]) or x not in want[:k]])


def test_jaccard_family_beyond_a_tile(spark, monkeypatch):
    """Thousands of near copies whose similarities lie on both sides of the bound, in several tiles; links stay linear."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for k in range(700):
        copy = list(base)
        for at in rng.sample(range(90), rng.choice((0, 1, 1, 2, 3))):
            copy[at] = f"x{rng.randrange(10**9)}"
        rows.append((k, " ".join(copy)))
    monkeypatch.setattr(jaccard_join, "TILE", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met, verified = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *x: met.append(pairs.count()) or verified(pairs, *x))
    assert brute.collected(jaccard_join.join_components(docs), *GROUPS) == brute.components(rows)
    assert sum(met) < 10 * len(rows)


@pytest.mark.parametrize("common", [3, 24, 1_000_000])
def test_jaccard_near_the_threshold(spark, common):
    """Sets whose similarity lies just at, above and below 0.8, of many sizes, with shared passages and chains."""
    rng = random.Random(7)
    made = []
    shared = [f"s{k}" for k in range(60)]
    for n in (5, 6, 8, 9, 10, 13, 14, 18, 23, 40, 41, 90, 91, 200, 450):
        text = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        for edits in range(0, max(2, n // 30 + 2)):
            copy = list(text)
            for k in rng.sample(range(n), min(edits, n)):
                copy[k] = f"x{rng.randrange(10**9)}"
            made.append(copy)
        made.append(text[: max(1, n * 9 // 10)])
        made.append(text[n // 10 :] + shared[: n // 6])
        made.append(shared + text)
    step = [f"c{k}" for k in range(300)]
    made += [step[k : k + 240] for k in range(0, 60, 6)]
    made += [["a"] * k for k in range(1, 9)]
    rows = [(k, " ".join(m)) for k, m in enumerate(made)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert brute.collected(jaccard_join.join_components(docs, common_least=common), *GROUPS) == brute.components(rows)


def test_quality_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.1"
    got = llm.op7_compression_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    y = np.array([r["quality"] for r in got])
    s = np.array([r["score"] for r in got])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.8 and ((s >= 0) & (s <= 1)).all()
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_quality_equals_a_plain_version(spark, rows):
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    want = brute.quality_scores(rows, labels)
    got = llm.op7_compression_quality(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9) and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (brute.zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word and word " * 400_000), (2, None)], "doc_id long, text string")
    sample = [b"plain good prose about rivers and trees %d" % k for k in range(60)], [b"zzz qqq %d ### !!!" % (k * k) for k in range(60)]
    got = quality.classify(docs, quality.fit(*sample, 0.5)).collect()
    assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 0), (99, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.classify(odd, model)
    assert got.count() == len(ODD) and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.classify(none, model).count() == 0 and quality.keep_good(none, model).columns == none.columns
    assert quality.train(odd, labels.where("false")).weights.size == 0
    assert quality.keep_good(odd, quality.Model()).count() == len(ODD)


def test_quality_never_learns_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    one = quality.train(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (one.weights == quality.train(docs, turned).weights).all()


def test_cross_entropy_difference(spark, odd, none):
    texts = [t for _, t in ODD]
    target = [t for i, t in ODD if i in (4, 9)]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string").repartition(2)
    models = lm_score.train(frame(texts), frame(target), vocabulary=30)
    from collections import Counter

    count = Counter(w for t in texts for w in brute.words(t))
    vocabulary = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w.encode()))[:30], 1)}

    def losses(some, text):
        one, two, docs = Counter(), Counter(), 0
        for t in some:
            x = [vocabulary.get(w, 0) for w in brute.words(t)]
            docs += bool(x)
            one.update(x)
            two.update(zip([31, *x], x))
        x = [vocabulary.get(w, 0) for w in brute.words(text)]
        total = 0.0
        for a, b in zip([31, *x], x):
            single = (one[b] + 1) / (sum(one.values()) + 31)
            history = docs if a == 31 else one[a]
            total -= np.log(lm_score.MIX * two[a, b] / history + (1 - lm_score.MIX) * single if history else single)
        return total / max(1, len(x))

    got = {(r["doc_id"], r["n_words"]): r for r in lm_score.score(odd, models).collect()}
    for i, t in ODD:
        r = got[i, len(brute.words(t))]
        assert r["target_loss"] == pytest.approx(losses(target, t), abs=1e-9) and r["background_loss"] == pytest.approx(losses(texts, t), abs=1e-9)
        assert r["difference"] == pytest.approx(r["target_loss"] - r["background_loss"])
    assert lm_score.score(none, models).count() == 0
    empty = lm_score.train(none, none)
    assert lm_score.score(odd, empty).where("isnan(difference)").count() == 0


@pytest.mark.parametrize("seeds", (1, 2))
def test_cross_entropy_counts_are_exact_beyond_any_table(spark, monkeypatch, seeds):
    """More words and bigrams than the fixed tables of 32,768 words and 2^20 buckets could tell apart."""
    dice = random.Random(5)
    rows = [(k, " ".join(f"w{dice.randrange(60_000)}" for _ in range(60))) for k in range(4_000)]
    if seeds == 2:
        # Two words of one hash under the first seed.
        rows = rows[:50]
        whole = lm_score.word_hash
        one, two = (rows[0][1].split()[k].encode() for k in (0, 1))
        monkeypatch.setattr(lm_score, "word_hash", lambda w, seed: whole(one if w == two and seed == 0 else w, seed))
    good = {k for k, _ in rows if k % 3 == 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    target = docs.where("doc_id % 3 = 0").select("text") if seeds == 1 else F.col("doc_id") % 3 == 0
    tables, write = [], lm_score.materialize
    monkeypatch.setattr(lm_score, "materialize", lambda df, name: tables.append(name) or write(df, name))

    def counted(some):
        one, two = Counter(), Counter()
        for t in some:
            x = t.split()
            one.update(x)
            two.update(zip([None, *x], x))
        return one, two, len(some)

    models = [counted([t for k, t in rows if k in good]), counted([t for _, t in rows])]
    size = len(models[1][0]) + 1
    got = {r["doc_id"]: r for r in lm_score.score(docs, lm_score.train(docs, target)).collect()}
    assert len(got) == len(rows) and tables.count("counts") == seeds
    for k, t in rows:
        x = t.split()
        own = counted([t])
        # A document's own counts are left out: always of the background, of the target where it is told which are target.
        for (one, two, n), column, out in zip(models, ("target_loss", "background_loss"), (seeds == 2 and k in good, True)):
            total, words = 0.0, one.total() - out * len(x)
            for a, b in zip([None, *x], x):
                history = n - out if a is None else one[a] - out * own[0][a]
                single = (one[b] - out * own[0][b] + 1) / (words + size)
                total -= np.log(lm_score.MIX * (two[a, b] - out * own[1][a, b]) / history + (1 - lm_score.MIX) * single if history else single)
            assert got[k][column] == pytest.approx(total / len(x), abs=1e-9)


def test_cross_entropy_tells_repeated_texts_apart(spark):
    """A text that occurs twice is known to the background without its own counts; one that occurs once is not."""
    dice = random.Random(6)
    fresh = lambda: " ".join(f"w{dice.randrange(3_000)}" for _ in range(80))
    rows = [(k, fresh()) for k in range(300)]
    rows += [(1_000 + k, rows[k][1]) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    got = {r["doc_id"]: r["difference"] for r in lm_score.score(docs, lm_score.train(docs, F.col("doc_id") % 3 == 200)).collect()}
    twice = [d for k, d in got.items() if k < 20 or k >= 1_000]
    assert min(twice) > max(d for k, d in got.items() if 20 <= k < 1_000)


WARC = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def read_back(pages):
    folder, captures = warc.write_archives(pages, archive_bytes=3_000)
    index = warc.build_index(captures, lines=4, limit=20)
    return folder, captures, index


def test_archives(spark):
    some = [(k, f"https://www.h{k % 3}.example.org/p?{k % 5}", f"<p>{k % 4}</p>" * 9) for k in range(60)]
    some += [(70, None, None), (71, "", ""), (72, "http://[bad", "é漢"), (7, "https://other.org/", "<p>x"), (7, "https://other.org/", "<p>x"), (7, "https://other.org/", "<p>y"), (None, "http://a.b/", "alone"), (73, "http://A.b:8080/Q#frag\r\nX: y", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in some], "page_id long, url string, html string, digest string, key string").repartition(3)
    folder, captures, index = read_back(pages)
    got = warc.fetch(folder, warc.lookup(index, warc.wanted_keys(pages)), payload=True)
    assert brute.collected(got, *WARC) == brute.archive(some)
    bodies = {r["page_id"]: r["html"] for r in got.where("record_type = 'response'").collect()}
    assert bodies[72] == "é漢" and bodies[73] == "\r\n\r\nWARC/1.1\r\n"
    key = warc.url_key("http://h1.example.org/p?1")
    assert key == "org,example,h1)/p?1"
    want = sorted(i for i, u, _ in some if u and warc.url_key(u) == key)
    one = spark.createDataFrame([(key, None)], "key string, page_id long")
    assert sorted(r["page_id"] for r in warc.lookup(index, one, any_page=True).collect()) == want
    file = captures.select("file").first()[0]
    with gzip.open(f"{folder.removeprefix('file://')}/{file}") as f:
        assert f.read().count(b"WARC-Record-ID: <urn:page:") == captures.where(F.col("file") == file).count()


def test_archives_of_the_small_table(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert brute.collected(llm.op9_warc_capture_index(spark, SF), *WARC) == brute.archive(pages)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    folder, _, index = read_back(empty)
    assert warc.fetch(folder, warc.lookup(index, warc.wanted_keys(empty))).count() == 0


def check_packing(got, rows, capacity=2048):
    from collections import defaultdict

    pieces = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got]
    want = []
    for i, t in rows:
        x = brute.ids("word_bpe_49k.json", t)
        want += [(i, k, a, len(x[a : a + capacity]), brute.crc(x[a : a + capacity])) for k, a in enumerate(range(0, len(x), capacity))]
    assert brute.in_order(pieces) == brute.in_order(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.02 * brute.best_fit_bins([p[3] for p in want], capacity) + 1


def test_packing(spark, odd, none, rows):
    check_packing(packing.pack(odd).collect(), ODD)
    assert packing.pack(none).count() == 0
    check_packing(llm.op10_best_fit_packing(spark, SF).collect(), rows)


@pytest.mark.parametrize("sizes", [[1024] * 50, [1000] * 80 + [24] * 90, list(range(1, 2049, 7)), [2048] * 9 + [1], [1025] * 40 + [1023] * 39, [700] * 100])
def test_placing_ties(spark, sizes):
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, item_size long").repartition(3)
    got = packing.place(items).collect()
    assert sorted(r["item"] for r in got) == list(range(len(sizes)))
    used = {}
    for r in got:
        used.setdefault(r["bin"], []).append((r["bin_at"], sizes[r["item"]]))
    for x in used.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(used) <= 1.02 * brute.best_fit_bins(sizes, 2048) + 1


@pytest.mark.parametrize("size", [1, 10, 40])
def test_rounds_do_not_follow_the_items_of_a_sequence(spark, monkeypatch, size):
    """Thousands of tiny items in each of few sequences take few rounds, also beside large ones."""
    rounds = []
    once = packing.one_round
    monkeypatch.setattr(packing, "one_round", lambda state: rounds.append(1) or once(state))
    sizes = [size] * 10_000 + list(range(100, 2048, 40))
    got = packing.place(spark.createDataFrame(list(enumerate(sizes)), "item long, item_size long").repartition(3)).collect()
    used = {}
    for r in got:
        used.setdefault(r["bin"], []).append((r["bin_at"], sizes[r["item"]]))
    for x in used.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(got) == len(sizes) and len(used) <= 1.02 * brute.best_fit_bins(sizes, 2048) + 1 and len(rounds) <= 20


@pytest.mark.parametrize("seed", range(20))
def test_filling_a_range(seed):
    """Gaps never overflow, nothing is lost, and no item is left that a gap of the range could still hold."""
    rng = np.random.default_rng(seed)
    n, m = rng.integers(0, 30, 2)
    size = np.concatenate([rng.integers(1, 200, n), rng.integers(1, rng.choice([3, 30, 200]), m)]).astype(np.int64)
    kind = np.concatenate([np.zeros(n, np.int32), np.ones(m, np.int32)])
    order = np.lexsort((kind, -size))
    kind, size, ids = kind[order], size[order], np.arange(n + m)
    (item, own, bins, gap), (changed, rest), left, free = packing.fill(kind, ids, size)
    assert sorted([*item, *left]) == np.flatnonzero(kind == 1).tolist() and sorted([*changed, *free]) == np.flatnonzero(kind == 0).tolist()
    for b, r in zip(changed, rest):
        inside = sorted(((g, s) for g, s, x in zip(gap, own, bins) if x == b), reverse=True)
        at = size[b]
        for g, s in inside:
            assert g == at and s <= at
            at -= s
        assert at == r
    if len(left):
        assert max([0, *rest, *size[free]]) < size[left].min()


def test_placing_by_shuffle(spark, monkeypatch):
    """Gaps handed over between ranges by a shuffle, as where they are many."""
    monkeypatch.setattr(packing, "_FEW", -1)
    sizes = list(range(1, 2049, 9))
    got = packing.place(spark.createDataFrame(list(enumerate(sizes)), "item long, item_size long").repartition(3)).collect()
    used = Counter()
    for r in got:
        used[r["bin"]] += sizes[r["item"]]
    assert len(got) == len(sizes) and max(used.values()) <= 2048 and len(used) <= 1.02 * brute.best_fit_bins(sizes, 2048) + 1


@pytest.mark.parametrize("wanted", [1, 2, 700, 2_999, 3_000])
def test_the_hash_of_a_rank(spark, wanted):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 2_990), np.arange(2**40, 2**40 + 10)])
    items = spark.createDataFrame([(int(v),) for v in values], "h long")
    found = packing.nth_hash(items, wanted)
    assert (values <= found).sum() == wanted


def test_search(spark, odd, none, rows):
    docs = [r for r in ODD if r[0] is not None]
    asked = [(1, "fox river"), (2, None), (3, "absentword"), (4, " ".join(brute.PROSE)), (5, "two three rights")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    index = topk_search.build(odd.where("doc_id is not null"))
    got = sorted(tuple(r) for r in topk_search.search(index, queries, k=4).collect())
    want = brute.bm25(docs, asked, 4)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    # Rows of one query id are one query of all their words.
    twice = spark.createDataFrame([(1, "fox"), (1, "river fox"), (1, "fox river"), (9, None)], "query_id long, text string")
    assert sorted(tuple(r)[1:] for r in topk_search.search(index, twice, k=4).collect()) == [g[1:] for g in got if g[0] == 1]
    assert topk_search.search(topk_search.build(none), queries).count() == 0
    assert topk_search.search(index, queries.where("false")).count() == 0


def test_pruned_search_is_exact(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = [(i, t) for i, t in rows if i % 20 == 0]
    got = sorted(tuple(r) for r in topk_search.search(topk_search.build(docs), spark.createDataFrame(asked, "query_id long, text string")).collect())
    want = brute.bm25(rows, asked)
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    # Sums of logarithms differ in their last digits, so equal scores may stand in another order: they are compared as sets.
    tied = lambda some: {(q, round(s, 4)): set() for q, _, _, s in some}
    mine, theirs = tied(want), tied(want)
    for group, some in ((mine, got), (theirs, want)):
        for q, _, d, s in some:
            group[min(((k[1] - s) ** 2, k) for k in group if k[0] == q)[1]].add(d)
    last = {q: min(s for x, _, _, s in want if x == q) for q, _, _, _ in want}
    assert all(mine[k] == theirs[k] or abs(k[1] - last[k[0]]) < 2e-4 for k in theirs)


def test_search_without_query_ids(spark, rows):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "green tree")], "doc_id long, text string")
    asked = spark.createDataFrame([(None, "red fox"), (7, "tree"), (None, "blue"), (8, None)], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]) for r in topk_search.search(topk_search.build(docs), asked).collect()}
    assert got == {(None, 1), (None, 2), (7, 3)}


def test_one_document_whatever_the_columns(spark):
    """Names that the operator uses inside, and a column without an order."""
    rows = [(i, t, "x", "y", 1, {"k": i or 0}) for i, t in ((5, "a b c d e f"), (5, "a b c d e f"), (None, "one two three four five six"), (None, "one two three four five six"), (6, "a b c d e f"), (7, ""))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _node string, __n int, m map<string, long>")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "one two three four five six"), (5, "a b c d e f"), (7, "")]


def test_search_skips_blocks(rows):
    """With a threshold, whole blocks stay unread and few documents are scored; the result stays that of all scores."""
    import pyarrow as pa

    docs = [(i, t) for i, t in rows for _ in range(1)] + [(10_000 + k, f"zebra quagga {k} " * 3) for k in range(40)]
    term, text, count, words = topk_search.term_sets(pa.array([t for _, t in docs], pa.string()))
    shard = topk_search.Shard.build([(np.array([i for i, _ in docs]), term, text, count, words)]).weigh(float(np.mean(words)))
    df = np.diff(shard.starts)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    for query in (len(docs) - 1, 3, 70):
        own = np.flatnonzero(np.isin(shard.terms, term[text == query]))
        whole = np.zeros(len(docs))
        for t in own:
            at = slice(shard.starts[t], shard.starts[t + 1])
            whole[shard.docs[at]] += idf[t] * shard.part[at]
        whole = np.round(whole, topk_search.DIGITS)
        want = np.lexsort((shard.doc_ids, -whole))[:10]
        for floor in (0.0, whole[want[-1]]):
            shard.skipped = shard.scored = 0
            found, scores = shard.search(shard.terms[own], idf[own], 10, floor)
            assert found.tolist() == want.tolist() and scores == pytest.approx(whole[want])
            assert shard.scored < len(docs)
            if query == len(docs) - 1 and floor:
                assert shard.skipped >= len(rows) // topk_search.BLOCK - 1


@pytest.mark.parametrize("seed", [1, 2])
def test_search_of_many_queries(seed):
    """All queries of a step at once, over several runs with tables: the top lists of all scores, and few documents scored in full."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    texts = [" ".join(f"w{w}" for w in np.minimum(rng.zipf(1.3, rng.integers(1, 120)), 3_000)) for _ in range(2_600)]
    texts += texts[:30] + [texts[7]] * 12 + [None, "", "alone"]
    term, text, count, words = topk_search.term_sets(pa.array(texts, pa.string()))
    ids = rng.permutation(len(texts)) - 5
    shard = topk_search.Shard.build([(ids, term, text, count, words)]).weigh(float(np.mean(words)))
    assert len(shard.runs) == 3 and all(len(table) for _, _, table, _ in shard.runs) and len(shard.list_docs)
    df = np.diff(shard.starts)
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    queries = np.arange(0, len(texts), 5)
    own = [np.searchsorted(shard.terms, np.sort(term[text == q])) for q in queries]
    whole = np.zeros((len(queries), len(texts)))
    for row, some in zip(whole, own):
        for t in some:
            at = slice(shard.starts[t], shard.starts[t + 1])
            row[shard.docs[at]] += idf[t] * shard.part[at]
    whole = np.round(whole, topk_search.DIGITS)
    order = [np.lexsort((shard.doc_ids, -row))[:10] for row in whole]
    asked = topk_search.Queries.of(shard.terms[np.concatenate(own)], idf[np.concatenate(own)], np.array([len(x) for x in own]))
    last = np.array([row[o[-1]] for row, o in zip(whole, order)])
    for floors in (np.zeros(len(queries)), last):
        shard.scored = shard.skipped = 0
        got = {q: (docs, scores) for q, docs, scores in shard.search_all(asked, 10, floors)}
        for q, (row, o) in enumerate(zip(whole, order)):
            want = o[row[o] > 0]
            docs, scores = got.get(q, (want[:0], row[:0]))
            assert shard.doc_ids[docs].tolist() == shard.doc_ids[want].tolist() and scores == pytest.approx(row[want], abs=2e-6)
        assert shard.scored < 40 * len(queries) and shard.skipped
