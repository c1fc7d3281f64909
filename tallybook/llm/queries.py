"""The registered queries of this subpackage, with production parameters, and their oracle SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    bpe,
    chat,
    decontamination,
    exact_dedup,
    langid,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    quality,
    ranking,
    secrets,
    sharding,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(_table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


# Target weights of the mix; sources are evened out by a power of their own shares.
MIX = {
    "source": 0.5,
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {"prose": 0.7, "symbols": 0.02, "shouting": 0.02},
}


def mixed(docs: DataFrame) -> DataFrame:
    """Documents with their topic and whether the mix draws them; the draw is fixed by the id."""
    text, doc_id = F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.conv(F.substring(F.md5(doc_id.cast("binary")), 1, 8), 16, 10).cast("double")
    return mixing.mix(
        docs.withColumn("topic", mixing.topic(text)),
        MIX,
        tokens=mixing.token_count(text),
        draw=draw / F.lit(float(1 << 32)),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs).select(
        "doc_id", "source", "lang", "topic", "tokens",
        F.round("probability", 9).alias("probability"), "sampled",
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~langid.held_out())
    vectors = quality.word_vectors(docs)
    network = quality.train(docs, labels, vectors)
    return quality.score(docs, vectors, network).select(
        "doc_id",
        langid.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score"
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.benchmark_hits(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    named = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_manifest(_table(spark, sf_dir, "documents"))


def shard_manifest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Where each document goes; rows are told apart by id and text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shuffle_into_shards(rows, n_shards, ("doc_id", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.near_duplicate_lines(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.col("n_dropped").cast("bigint").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secrets.BASE_RULES]

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        texts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(texts, ",")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def leaf(n_chars):
        values = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
        return merkle.digest(*[merkle.field(value) for value in values])

    n_chars = F.col("n_chars")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = _table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        leaf(n_chars).alias("leaf"),
        F.when(tampered, leaf(n_chars + 1)).alias("tampered"),
    )
    tree = merkle.manifest(leaves, "leaf", "lang", "doc_id", ["doc_id", "tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return tree.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    numbers = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        "ids",
    )
    kept = ["doc_id", "n_tokens", "ids_sha256"]
    return bpe.decode(encoded, tokenizer, kept).select(
        *kept, F.sha2("text", 256).alias("decoded_sha256")
    )


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_mixing": op3_mixing,
        "op4_quality": op4_quality,
        "op5_langid": op5_langid,
        "op6_decontamination": op6_decontamination,
        "op7_sharding": op7_sharding,
        "op8_line_dedup": op8_line_dedup,
        "op9_secrets": op9_secrets,
        "op10_chat": op10_chat,
        "op11_ranked_search": op11_ranked_search,
        "op12_merkle": op12_merkle,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": _EXACT_SQL,
        "op3_mixing": _mixing_sql(),
        "op11_ranked_search": _RANK_SQL,
        "op12_merkle": _MERKLE_SQL,
    }


_EXACT_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n
           FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(n) AS text_sha256
FROM t WINDOW same AS (PARTITION BY n)
"""


_RANK_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark),
wanted AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM i),
lengths AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
found AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE
                                    / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM found GROUP BY term),
scores AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) //
           (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN found USING (term) JOIN lengths USING (r), total
  GROUP BY i, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS place
  FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(
    _FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")
) + ")"
_MERKLE_SQL = f"""
WITH RECURSIVE
docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF.format("n_chars")} AS leaf,
         {_LEAF.format("(n_chars + 1)")} AS changed,
         -- CRC-32 of the digits, bit by bit
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT,
             list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, b: list_reduce(
             list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda s, z: xor(s >> 1, (s & 1) * 3988292384::BIGINT)))) AS crc
  FROM documents),
leaves AS (
  SELECT r, doc_id, lang, leaf, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM docs),
tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, level AS height, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
         count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
climb AS (
  SELECT r, lang, 0 AS level, pos, shown AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.r, c.lang, c.level + 1, c.pos // 2,
         sha256(CASE WHEN c.pos % 2 = 0 THEN folded || coalesce(s.node, '')
                     ELSE s.node || folded END),
         proof || coalesce(s.node, '')
  FROM climb AS c
  JOIN tree AS own ON own.lang IS NOT DISTINCT FROM c.lang AND own.level = c.level
                   AND own.pos = c.pos AND own.n > 1
  LEFT JOIN tree AS s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level
                      AND s.pos = xor(c.pos, 1)),
climb_on AS (
  SELECT c.r, 0 AS level, u.pos, folded, proof
  FROM climb AS c JOIN subroots AS u ON u.lang IS NOT DISTINCT FROM c.lang AND u.height = c.level
  UNION ALL
  SELECT c.r, c.level + 1, c.pos // 2,
         sha256(CASE WHEN c.pos % 2 = 0 THEN folded || coalesce(s.node, '')
                     ELSE s.node || folded END),
         proof || coalesce(s.node, '')
  FROM climb_on AS c
  JOIN top AS own ON own.level = c.level AND own.pos = c.pos AND own.n > 1
  LEFT JOIN top AS s ON s.level = c.level AND s.pos = xor(c.pos, 1)),
root AS (SELECT level AS height, node FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, u.node AS subroot, root.node AS root, sha256(c.proof) AS proof_sha256,
       c.folded AS folded_root, c.folded = root.node AS verified
FROM leaves AS l
JOIN subroots AS u ON u.lang IS NOT DISTINCT FROM l.lang
CROSS JOIN root
JOIN climb_on AS c ON c.r = l.r AND c.level = root.height
"""


def _mixing_sql() -> str:
    def weighted(margin: str) -> str:
        cases = "".join(f" WHEN '{k}' THEN {float(v)}" for k, v in MIX[margin].items())
        return f"CASE {margin}{cases} END"

    steps = [
        r"""docs AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
         CASE WHEN regexp_matches(text, '[$%&*#]{3}') THEN 'symbols'
              WHEN contains(text, '!!') THEN 'shouting' WHEN contains(text, ' | ') THEN 'list'
              WHEN regexp_matches(text, '[0-9]') THEN 'figures' ELSE 'prose' END AS topic,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS draw
  FROM documents)""",
        """cells AS (
  SELECT source, lang, topic, sum(tokens)::DOUBLE AS own,
         sum(tokens)::DOUBLE / sum(sum(tokens)::DOUBLE) OVER () AS weight
  FROM docs GROUP BY ALL HAVING sum(tokens) > 0)""",
        "by_source AS (SELECT source, sqrt(sum(weight)) AS share FROM cells GROUP BY source)",
    ]
    for margin in ("lang", "topic"):
        rest = 1 - sum(MIX[margin].values())
        steps.append(
            f"""own_{margin} AS (
  SELECT {margin}, sum(weight) AS own, {weighted(margin)} AS given FROM cells GROUP BY {margin})"""
        )
        # Values without a weight share the rest, or keep their own share where nothing is left.
        shared = (
            f"coalesce(given * (1 - free) / listed, own)"
            if rest < mixing._NOTHING_LEFT
            else f"coalesce(given, {rest} * own / free)"
        )
        steps.append(
            f"""by_{margin} AS (
  SELECT {margin}, CASE WHEN free > 0 THEN {shared} ELSE given END AS share FROM (
    SELECT *, sum(CASE WHEN given IS NULL THEN own END) OVER () AS free,
           sum(given) OVER () AS listed FROM own_{margin}))"""
        )
    state = "cells"
    for number in range(mixing.ROUNDS):
        for margin in MIX:
            after = f"{margin}_{number}"
            steps.append(
                f"""{after} AS (
  SELECT c.source, c.lang, c.topic, own, weight * (share / (SELECT sum(share) FROM by_{margin}))
         / sum(weight) OVER (PARTITION BY c.{margin}) AS weight
  FROM {state} AS c JOIN by_{margin} AS b ON c.{margin} IS NOT DISTINCT FROM b.{margin})"""
            )
            state = after
    steps.append(
        f"""factors AS (
  SELECT source, lang, topic, weight / own / (SELECT max(weight / own) FROM {state}) AS p
  FROM {state})"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(p, 1.0), 9) AS probability,
       draw < coalesce(p, 1.0) AS sampled
FROM docs AS d LEFT JOIN factors AS f
  ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang
 AND d.topic = f.topic"""
    )
