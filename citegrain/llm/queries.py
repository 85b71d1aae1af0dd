"""The registered queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import (
    bpe_counts, decontaminate, mixture, ngram_bloom, prefix_trie, sharding, simhash, sketches, suffixes, toxicity, transcripts, url_rules, va_clusters
)
from citegrain.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that another document holds too."""
    return suffixes.repeated_spans(read(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assigned(read(spark, sf_dir, "documents"), 8)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.grouped(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The rules that the URL query applies: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judged(read(spark, sf_dir, "pages"), rules)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.with_neighbours(read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_bloom.scored(read(spark, sf_dir, "documents"))


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """Turns as pieces of raw transcripts: each conversation in one of four styles of speaker markers,
    a seventh of the pieces without any."""
    role = F.col("role")
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("Instructions")
    styles = F.array(
        F.concat(F.initcap(role), F.lit(": ")), F.concat(F.lit("### "), human, F.lit(":\n")),
        F.concat(F.lit("<|im_start|>"), role, F.lit("\n")), F.concat(F.lit("**"), human, F.lit(":** ")),
    )
    marker = F.when((F.col("conv_id") + F.col("turn")) % 7 == 3, "").otherwise(F.get(styles, F.pmod("conv_id", F.lit(4)).cast("int")))
    return turns.withColumn("text", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from transcripts written out of the given turns, and the turns rendered."""
    raw = raw_transcripts(read(spark, sf_dir, "conversations"))
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = transcripts.fit(raw.filter(~held_out))
    rows = transcripts.parsed(raw.select("conv_id", "turn", "text"), model)
    return rows.select("conv_id", "turn", held_out.alias("held_out"), "role", "opens", "n_lines", "n_turns", "rendered")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = va_clusters.clustered(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The tokens that a document may have.
TOKEN_LIMIT = 1024


def op12_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    rows = bpe_counts.with_token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(tokenizer))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    return rows.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that share the first turns of their hundred's first one."""
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.numbered(read(spark, sf_dir, "conversations")), conv - conv % 100, head))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_mix_sources, op3_toxicity, op4_suffix_dedup, op5_shard, op6_simhash, op7_url_filter, op8_fingerprints,
        op9_lm_scores, op10_chat_format, op11_centroids, op12_token_counts, op13_prefix_trie,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_words(text: str, separators: str) -> str:
    lowered = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    return f"list_filter(string_split_regex({lowered}, '{separators}'), lambda x: x <> '')"


_LETTER_WORDS = _sql_words("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SQL: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_LETTER_WORDS} AS w FROM documents),
        item AS (SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark),
        gram AS (
          SELECT DISTINCT item_id, w[i : i + least(len(w), 10) - 1] AS g
          FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT len(g) AS n FROM gram),
        starts AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
        hit AS (
          SELECT DISTINCT doc_id, i, n, item_id
          FROM (SELECT doc_id, i, n, w[i : i + n - 1] AS g FROM starts) JOIN gram USING (g)),
        pos AS (
          SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
        items AS (
          SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
          CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op2_mix_sources": r"""
        WITH sized AS (
          SELECT doc_id, source, md5('0:' || doc_id) AS place,
            CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
          FROM documents),
        sums AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
          FROM sized GROUP BY source),
        caps AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM sums),
        levels AS (
          SELECT *, cap / weight AS ratio,
            (sum(source_size) OVER () - coalesce(sum(cap) OVER below, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
          FROM caps
          WINDOW below AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
        targets AS (
          SELECT source, source_size, rank, least(CAST(cap AS DOUBLE), chosen.level * weight) AS target FROM levels, chosen),
        queue AS (
          SELECT doc_id, size, source_size, rank, target,
            CAST(sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS before
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        copies AS (
          SELECT doc_id, size,
            sum(size) OVER (ORDER BY (before + copy * source_size) / target, rank, before ROWS UNBOUNDED PRECEDING) AS running
          FROM queue, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
        taken AS (
          SELECT doc_id, sum(size) AS taken FROM copies WHERE running <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
        SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
        FROM queue LEFT JOIN taken USING (doc_id)""",
    "op7_url_filter": r"""
        WITH urls AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
          FROM pages),
        rules AS (
          SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
            ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) AS r(rule_host, rule_path, verdict)),
        fits AS (
          SELECT page_id, rule_host || rule_path AS rule, verdict,
            row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) AS nth
          FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM urls LEFT JOIN (SELECT * FROM fits WHERE nth = 1) USING (page_id)""",
}


def _centroid_sql(dims: int = 64, k: int = 40, rounds: int = 5) -> str:
    """Rounds of assignment and exact floor means, written out one after the other."""
    steps = [f"""v AS (
          SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
          FROM embeddings
          WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
        c0 AS (
          SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS cluster, x AS c FROM v ORDER BY cluster LIMIT {k})"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
          SELECT row, vec_id, x, cluster, c, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
          FROM v, c{r}),
        a{r} AS (
          SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
          SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mean
          FROM (SELECT cluster, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
                FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY cluster, i) GROUP BY cluster),
        c{r + 1} AS (SELECT cluster, coalesce(mean, c) AS c FROM c{r} LEFT JOIN m{r} USING (cluster))""")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
          CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds}"""


SQL["op11_centroids"] = _centroid_sql()

SQL["op13_prefix_trie"] = """
        WITH turns AS (
          SELECT conv_id AS c, length(coalesce(text, '')) AS chars, g,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos
          FROM (SELECT *, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS g FROM conversations WHERE conv_id IS NOT NULL)),
        convs AS (
          SELECT c, count(*) AS n, c - c % 100 AS donor,
            xor(list_reduce(
              list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(
                string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END),
              4294967295) % 6 AS h
          FROM turns GROUP BY c),
        kept AS (SELECT v.c, v.h, v.donor, least(v.h, coalesce(d.n, 0)) AS k FROM convs v LEFT JOIN convs d ON d.c = v.donor),
        seq AS (
          SELECT kept.c, pos AS j, g, chars FROM kept JOIN turns t ON t.c = kept.donor AND pos <= k
          UNION ALL SELECT kept.c, pos - h + k, g, chars FROM kept JOIN turns t ON t.c = kept.c AND pos > h),
        member AS (
          SELECT c, j, chars, sha256(string_agg(g, '') OVER (PARTITION BY c ORDER BY j)) AS id FROM seq
          UNION ALL SELECT c, 0, 0, '' FROM convs),
        node AS (SELECT j, id, count(*) AS n_convs, min(c) AS conv_id, max(chars) AS chars FROM member GROUP BY j, id),
        mine AS (SELECT m.c, m.j, m.id, conv_id, n_convs, node.chars FROM member m JOIN node ON node.j = m.j AND node.id = m.id),
        link AS (
          SELECT x.j, x.id, y.conv_id AS parent_conv_id, y.id AS parent
          FROM mine x LEFT JOIN mine y ON y.c = x.c AND y.j = x.j - 1 WHERE x.c = x.conv_id),
        kids AS (SELECT j - 1 AS j, parent AS id, count(*) AS n FROM link WHERE j > 0 GROUP BY ALL),
        totals AS (
          SELECT y.j, y.id, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
          FROM mine x JOIN mine y ON y.c = x.c AND y.j <= x.j LEFT JOIN kids ON kids.j = x.j AND kids.id = x.id
          WHERE x.c = x.conv_id GROUP BY y.j, y.id),
        ends AS (
          SELECT j, id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
          FROM (SELECT * FROM member QUALIFY row_number() OVER (PARTITION BY c ORDER BY j DESC) = 1) GROUP BY j, id)
        SELECT conv_id, CAST(node.j AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
          CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
          sha256(coalesce(ids, '')) AS ends_sha256
        FROM node JOIN link ON link.j = node.j AND link.id = node.id JOIN totals ON totals.j = node.j AND totals.id = node.id
          LEFT JOIN kids ON kids.j = node.j AND kids.id = node.id LEFT JOIN ends ON ends.j = node.j AND ends.id = node.id"""
