"""The ``opN_<name>`` queries: each operator over its whole table, with production parameters, in its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, language_id, licenses, merkle, mixing, near_dedup, packing, quality, secrets, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.learn(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scan fills the ledger; the second finds no blob unseen and joins the ledger's findings to all paths."""
    docs = _table(spark, sf_dir, "documents")
    _, ledger = secrets.scan_secrets(docs)
    found, _ = secrets.scan_secrets(docs, ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs; the tampered leaves meet the original siblings."""
    docs = _table(spark, sf_dir, "documents")
    fields = lambda n: [*map(F.col, ("doc_id", "source", "lang")), n, F.col("text")]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(touched, merkle.leaf(*fields(F.expr("try_add(n_chars, 1)"))))
    proofs = merkle.manifest(docs.select("doc_id", F.col("lang").alias("key"), merkle.leaf(*fields(F.col("n_chars"))).alias("leaf"), changed.alias("changed")))
    out = proofs.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    starts, names = F.col("places.start"), lambda c: F.col(f"{c}.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names("places")).alias("base_labels"), joined(F.concat(names("places"), names("spans"))).alias("labels"), "score",
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_quality_rules, op3_minhash, op4_toxicity, op5_packing, op6_url_filter, op7_exact_dedup, op8_token_counts, op9_mixing, op10_secrets)
    found += (op11_merkle_manifest, op12_license_scan, op13_centroid_clusters)
    return {f.__name__: f for f in found}


_HOST = "translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SITES = " OR ".join(f"bare = '{x.rstrip('/')}' OR ends_with(bare, '.{x.rstrip('/')}')" for x in url_filter.LISTED)


#: crc32 of a short ASCII text, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""
_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _clusters(rounds: int = 3) -> str:
    """Plain rounds over vectors of 64 components, one row for each component."""
    near = """a{0} AS (
                SELECT row, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (
                    SELECT x.row, m.c, CAST(sum((x.v - m.v) * (x.v - m.v)) AS BIGINT) AS d FROM x JOIN c{0} m USING (i) GROUP BY x.row, m.c) GROUP BY row
            )"""
    floor = "CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    parts = []
    for r in range(rounds):
        parts += [near.format(r), f"m{r} AS (SELECT a.c, x.i, {floor} AS v FROM x JOIN a{r} a USING (row) GROUP BY a.c, x.i)"]
        parts += [f"c{r + 1} AS (SELECT c.c, c.i, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (c, i))"]
    return f"""
            WITH k AS (
                SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
            ), n AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS row FROM k),
            x AS (SELECT row, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM n), c0 AS (SELECT row AS c, i, v FROM x WHERE row < 16),
            {", ".join(parts)}, {near.format(rounds)},
            h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{rounds} GROUP BY c)
            SELECT n.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
                CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
            FROM n JOIN a{rounds} a USING (row) JOIN h USING (c)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express over whole tables."""
    return {
        "op6_url_filter": f"""
            WITH parts AS (
                SELECT page_id, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
            ), ruled AS (
                SELECT *, regexp_replace(host, '^.*@|(:\\d*)?\\.*$|\\.*:\\d*$', '') AS bare, CASE
                    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
                FROM parts
            )
            SELECT page_id, host, path, rule,
                CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN {_SITES} THEN 'block' ELSE 'allow' END AS verdict,
                rule IS NULL AND ({_SITES}) AS listed
            FROM ruled""",
        "op7_exact_dedup": """
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
            g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
        # all levels of all trees: those of the languages, then the one over their roots
        "op11_merkle_manifest": f"""
            WITH RECURSIVE d AS (
                SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS changed,
                    coalesce({_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS touched FROM documents
            ), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
            nodes AS (
                SELECT tree, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM p
                UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2
            ), subroots AS (SELECT tree, level, node, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
            tops AS (
                SELECT 0 AS level, pos, node, count(*) OVER () AS n FROM subroots
                UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, pos // 2
            ), steps AS (
                SELECT tree, level, pos, node, n FROM nodes WHERE n > 1
                UNION ALL SELECT s.tree, s.level + t.level, t.pos, t.node, t.n FROM subroots s CROSS JOIN tops t WHERE t.n > 1
            ), path AS (
                SELECT p.doc_id, p.pos AS leaf_pos, p.tree, 0 AS level, p.pos, CASE WHEN touched THEN changed ELSE leaf END AS node, '' AS proof, s.level AS height, s.pos AS top FROM p JOIN subroots s USING (tree)
                UNION ALL
                SELECT q.doc_id, q.leaf_pos, q.tree, q.level + 1, q.here // 2, sha256(CASE WHEN q.here % 2 = 0 THEN q.node || coalesce(s.node, '') ELSE s.node || q.node END), q.proof || coalesce(s.node, ''), q.height, q.top
                FROM (SELECT *, CASE WHEN level = height THEN top ELSE pos END AS here FROM path) q
                JOIN (SELECT DISTINCT tree, level FROM steps) l ON l.tree = q.tree AND l.level = q.level
                LEFT JOIN steps s ON s.tree = q.tree AND s.level = q.level AND s.pos = xor(q.here, 1)
            ), ends AS (SELECT tree, leaf_pos, arg_max(node, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM path GROUP BY ALL)
            SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, e.proof_sha256, e.folded_root, e.folded_root = r.node AS verified
            FROM p JOIN subroots s USING (tree) JOIN ends e ON e.tree = p.tree AND e.leaf_pos = p.pos CROSS JOIN (SELECT node FROM tops WHERE n = 1) r""",
        "op13_centroid_clusters": _clusters(),
    }
