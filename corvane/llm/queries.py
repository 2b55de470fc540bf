"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair_store

    return repair_store.read_digests(repair_store.write(_table(spark, sf_dir, "documents")))


def op4_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import viterbi_count

    return viterbi_count.count(_table(spark, sf_dir, "documents"))


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    pages = _table(spark, sf_dir, "pages")
    folder, captures = warc.write_archives(pages)
    found = warc.lookup(warc.build_index(captures), warc.wanted_keys(pages))
    return warc.fetch(folder, found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.join_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk_search

    docs = _table(spark, sf_dir, "documents")
    wanted = docs.where("doc_id % 100 = 0").select(docs.doc_id.alias("query_id"), "text")
    return topk_search.search(topk_search.build(docs), wanted)


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_score

    docs = lm_score.with_target(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    found = lm_score.score(docs, lm_score.train(docs, docs.in_target))
    # Sums of logarithms differ in their last digits with the order of adding.
    return found.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")))


def op11_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import apportion

    return apportion.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ball_tree

    return ball_tree.cluster(_table(spark, sf_dir, "embeddings"))


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import run_detection

    found = run_detection.detect(_table(spark, sf_dir, "documents"), run_detection.repeat_tail)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op11_sainte_lague_mix": op11_sainte_lague_mix,
    "op12_ball_tree_clusters": op12_ball_tree_clusters,
    "op13_harmonic_runs": op13_harmonic_runs,
    "op2_block_max_wand": op2_block_max_wand,
    "op8_cross_entropy_difference": op8_cross_entropy_difference,
    "op6_partenum_jaccard": op6_partenum_jaccard,
    "op9_warc_capture_index": op9_warc_capture_index,
    "op1_license_scan": op1_license_scan,
    "op5_unigram_token_counts": op5_unigram_token_counts,
    "op7_compression_quality": op7_compression_quality,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op4_fm_index_decontamination": op4_fm_index_decontamination,
    "op3_repair_tokens": op3_repair_tokens,
}

#: Words of a text, as SQL: lower-case A-Z, runs of digits, letters and anything beyond ASCII.
_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _lloyd_sql(rounds: int = 10, k: int = 8) -> str:
    """Lloyd's rounds written out one after the other: c0 the start, a<i> the assignment to c<i>, c<i+1> its means."""
    near = "SELECT vec_id, x, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.vec_id, v.x, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, {} c) GROUP BY vec_id, x"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(f'c{i}')})")
        steps.append(f"""m{i} AS MATERIALIZED (
            SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY p) AS x
            FROM (SELECT j, p, CAST(sum(x[p]) AS BIGINT) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS p) GROUP BY j, p) GROUP BY j)""")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (j))")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k})),
        {", ".join(steps)},
        z AS MATERIALIZED ({near.format(f"c{rounds}")})
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM z JOIN c{rounds} c USING (j)"""


ORACLE: dict[str, str] = {
    "op13_harmonic_runs": r"""
        WITH d0 AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                    lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) AS c
            FROM documents),
        d1 AS (SELECT doc_id, ws, len(ws) AS n, xor(c, 4294967295) AS h FROM d0),
        d2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN h // 10 % n END AS a FROM d1),
        d3 AS (SELECT *, CASE WHEN a IS NOT NULL THEN 1 + (n - a) // (3 + h // 10 % 8) END AS q FROM d2),
        d AS MATERIALIZED (
            SELECT doc_id, n, row_number() OVER () AS r, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END]) END AS w FROM d3),
        e AS (SELECT r, p, unnest(list_filter(range(0, n - p), lambda i: w[i + 1] = w[i + p + 1])) AS i FROM (SELECT *, unnest(range(1, n // 4 + 1)) AS p FROM d)),
        s AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM e) GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
        run AS MATERIALIZED (SELECT r, start, length, min(p) AS period FROM s GROUP BY ALL),
        listed AS (
            SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                first(struct_pack(start := start, length := length, period := period) ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS best FROM run GROUP BY r),
        gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
        word AS (SELECT r, unnest(range(0, n)) AS i, unnest(w) AS x FROM d),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
            sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
        FROM d LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)""",
    "op12_ball_tree_clusters": _lloyd_sql(),
    "op11_sainte_lague_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
        s0 AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS number FROM d GROUP BY source),
        s1 AS (SELECT *, [3, 1, 2][number % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap FROM s0),
        s2 AS (
            SELECT *, row_number() OVER o AS place, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(source_size) OVER () AS whole
            FROM s1 WINDOW o AS (ORDER BY cap / weight, number)),
        s3 AS (SELECT *, (1.5::DOUBLE * whole - before) / weights AS level FROM s2),
        s4 AS (SELECT *, min(place) FILTER (cap > weight * level) OVER () AS open FROM s3),
        s5 AS (SELECT *, max(level) FILTER (place = open) OVER () AS rise FROM s4),
        s6 AS (SELECT source, source_size, number, CASE WHEN open IS NULL OR place < open THEN cap ELSE weight * rise END AS target FROM s5),
        house AS (SELECT CAST(floor(sum(target) / 256 + 0.5) AS BIGINT) AS seats FROM s6),
        quotients AS (
            SELECT number, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, number) AS place
            FROM (SELECT number, target, unnest(range(1, CAST(ceil(target / 256) AS BIGINT) + 8)) AS k FROM s6 WHERE target > 0)),
        won AS (SELECT number, count(*) AS seats FROM quotients, house WHERE place <= house.seats GROUP BY number),
        s AS (
            SELECT s6.*, coalesce(won.seats, 0) AS seats, CAST(floor(target + 0.5) AS BIGINT) AS goal, greatest(1, CAST(ceil(source_size / 262144) AS BIGINT)) AS shards
            FROM s6 LEFT JOIN won USING (number)),
        w AS (
            SELECT doc_id, size, key, s.* EXCLUDE (source), CAST('0x' || substr(key, 1, 8) AS BIGINT) % shards AS shard
            FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
        cell AS (SELECT number, shard, seats, goal, CAST(sum(size) AS BIGINT) AS words FROM w WHERE size > 0 GROUP BY ALL),
        cell_quotients AS (
            SELECT number, shard, seats, row_number() OVER (PARTITION BY number ORDER BY words / (2 * k - 1) DESC, shard) AS place
            FROM (SELECT number, shard, seats, words, unnest(range(1, seats + 1)) AS k FROM cell)),
        cell_won AS (SELECT number, shard, count(*) AS own FROM cell_quotients WHERE place <= seats GROUP BY ALL),
        cut AS (
            SELECT number, shard, words, goal, least(coalesce(own, 0) * 256, words * 2) AS take, goal - sum(least(coalesce(own, 0) * 256, words * 2)) OVER (PARTITION BY number) AS rest
            FROM cell LEFT JOIN cell_won USING (number, shard)),
        room AS (SELECT *, CASE WHEN rest > 0 THEN words * 2 - take ELSE take END AS room FROM cut),
        quota AS (
            SELECT number, shard, words, CAST(take + sign(rest) * least(room, greatest(abs(rest) - coalesce(sum(room) OVER (PARTITION BY number ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS BIGINT) AS take
            FROM room),
        block AS (
            SELECT number, shard, take // words AS whole, take % words AS more, b, least(256, words - 256 * b) AS length, md5('mix:' || number || ':' || shard || ':' || b) AS pick
            FROM (SELECT *, unnest(range(0, (words - 1) // 256 + 1)) AS b FROM quota)),
        part AS (
            SELECT number, shard, whole, b * 256 AS begin, greatest(0, least(length, more - coalesce(sum(length) OVER (PARTITION BY number, shard ORDER BY length < 256, pick, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS t
            FROM block),
        placed AS (
            SELECT *, coalesce(sum(size) OVER (PARTITION BY number, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, row_number() OVER () AS r FROM w WHERE size > 0)
        SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
            CAST(any_value(whole) * any_value(size) + sum(greatest(0, least(a + size, begin + t) - greatest(a, begin))) AS BIGINT) AS taken
        FROM placed JOIN part ON placed.number = part.number AND placed.shard = part.shard AND begin < a + size AND begin + 256 > a GROUP BY r
        UNION ALL SELECT doc_id, size, source_size, target, 0 FROM w WHERE size = 0""",
    "op2_block_max_wand": f"""
        WITH w AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
        g AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
        tf AS (SELECT doc_id, term, count(*) AS c, any_value(dl) AS dl FROM (SELECT doc_id, unnest(ws) AS term, len(ws) AS dl FROM w) GROUP BY ALL),
        idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, g GROUP BY term, n),
        s AS (
            SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.c * 2.2 / (d.c + 1.2 * (0.25 + 0.75 * d.dl / mean))), 6) AS score
            FROM (SELECT doc_id, term FROM tf WHERE doc_id % 100 = 0) q JOIN idf USING (term) JOIN tf d USING (term), g
            GROUP BY 1, 2)
        SELECT query_id, rank, doc_id, score
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
    "op8_cross_entropy_difference": f"""
        WITH d AS (SELECT doc_id, {_SQL_WORDS} AS ws, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t FROM documents),
        k AS (SELECT doc_id, t, unnest(ws) AS w, unnest(list_concat([''], ws[1:len(ws) - 1])) AS h FROM d WHERE len(ws) > 0),
        one AS (
            SELECT w, count(*) AS b, count(*) FILTER (t) AS g FROM k GROUP BY w
            UNION ALL SELECT '', count(*), count(*) FILTER (t) FROM d WHERE len(ws) > 0),
        two AS (SELECT h, w, count(*) AS b, count(*) FILTER (t) AS g FROM k GROUP BY h, w),
        mine AS (SELECT doc_id, w, count(*) AS c FROM k GROUP BY doc_id, w UNION ALL SELECT doc_id, '', 1 FROM d WHERE len(ws) > 0),
        pair AS (SELECT doc_id, h, w, count(*) AS c FROM k GROUP BY doc_id, h, w),
        tot AS (SELECT count(*) AS b, count(*) FILTER (t) AS g, count(DISTINCT w) + 1 AS v FROM k),
        x AS (
            SELECT p.doc_id, p.c, v, two.b - p.c AS pb, two.g - p.c * t::INT AS pg, sw.b - mw.c AS sb, sw.g - mw.c * t::INT AS sg,
                sh.b - mh.c AS hb, sh.g - mh.c * t::INT AS hg, tot.b - len(ws) AS tb, tot.g - len(ws) * t::INT AS tg
            FROM pair p JOIN d USING (doc_id) JOIN two USING (h, w) JOIN one sw ON sw.w = p.w JOIN one sh ON sh.w = p.h
            JOIN mine mw ON mw.doc_id = p.doc_id AND mw.w = p.w JOIN mine mh ON mh.doc_id = p.doc_id AND mh.w = p.h, tot),
        l AS (
            SELECT doc_id, sum(c * -ln(CASE WHEN hg > 0 THEN 0.6 * pg / hg + 0.4 * (sg + 1) / (tg + v) ELSE (sg + 1) / (tg + v) END)) AS g,
                sum(c * -ln(CASE WHEN hb > 0 THEN 0.6 * pb / hb + 0.4 * (sb + 1) / (tb + v) ELSE (sb + 1) / (tb + v) END)) AS b
            FROM x GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, round(coalesce(g / len(ws), 0), 6) AS target_loss, round(coalesce(b / len(ws), 0), 6) AS background_loss,
            round(coalesce(g / len(ws) - b / len(ws), 0), 6) AS difference
        FROM d LEFT JOIN l USING (doc_id)""",
    "op4_fm_index_decontamination": f"""
        WITH d AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
        win AS (
            SELECT DISTINCT item, m, array_to_string(ws[p:p + m - 1], ' ') AS s
            FROM (SELECT item, ws, least(len(ws), 13) AS m, unnest(range(1, greatest(len(ws) - 11, 2))) AS p FROM i WHERE len(ws) > 0)),
        place AS (
            SELECT doc_id, m, p, array_to_string(ws[p:p + m - 1], ' ') AS s
            FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)),
        found AS (SELECT doc_id, m, p, item FROM place JOIN win USING (m, s)),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM found)) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_partenum_jaccard": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, hash(array_to_string(ws[p:p + 4], ' ')) AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (
            SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
            JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
        r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)""",
    "op9_warc_capture_index": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS body,
                count(*) OVER (PARTITION BY coalesce(html, '')) AS copies, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
            FROM pages),
        bits AS (
            SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(h, i, 1))]), '') AS b
            FROM p)
        SELECT page_id, size AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda k: CAST(substr(b, 5 * j + k + 1, 1) AS INTEGER) * (16 >> k))) AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN copies > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN copies > 1 AND page_id <> last THEN last END AS refers_to
        FROM bits""",
}
