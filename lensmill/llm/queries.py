"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.llm import chat, decontaminate, html_text, jaccard_join, language, mixing, quality, sharding, tiff, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


#: A-Z to lower case, and the words of a text.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_sql(source: str, n: int, num: int, den: int) -> str:
    """CTEs shingled, counted, linked and reached over the rows of ``source``."""
    parts = " || ' ' || ".join(f"ws[i + {k}]" for k in range(n))
    return rf"""
    worded AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM {source}),
    shingled AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < {n} THEN array_to_string(ws, ' ') ELSE {parts} END AS sh
                 FROM worded, unnest(range(1, greatest(len(ws) - {n - 1}, 1) + 1)) AS t(i) WHERE len(ws) > 0),
    counted AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
    paired AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingled a JOIN shingled b USING (sh)
               WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    linked AS (SELECT x, y FROM paired JOIN counted p ON p.doc_id = x JOIN counted q ON q.doc_id = y
               WHERE {den} * c >= {num} * (p.n + q.n - c)),
    same AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS d FROM shingled GROUP BY doc_id),
    reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN linked l ON l.x = r.y)"""


#: A one-row CTE with the 256 entries of the crc32 table, worked out from its rule.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entry)"""


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, beside CRC_TABLE."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "xor(a >> 8, entry[(xor(a, v) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, v: {step}), 4294967295::BIGINT)"


def mixing_sql(source: str, seed: str = "mix") -> str:
    """CTEs up to mixed, with doc_id, size, source_size, target and taken."""
    return rf"""
    sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
              md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM {source}),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM totals),
    levelled AS (SELECT *, cap / w AS r, ((sum(source_size) OVER ())
                 - coalesce(sum(cap) OVER (ORDER BY cap / w, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(w) OVER (ORDER BY cap / w, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    targets AS (SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(level, (r, cap)) FROM levelled WHERE r >= level)), cap) AS target FROM levelled),
    parted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
    ordered AS (SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
                sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
                FROM sized s JOIN parted p ON s.source IS NOT DISTINCT FROM p.source),
    mixed AS (SELECT doc_id, source, size, source_size, target,
              (size * (whole + CASE WHEN rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM ordered)"""


def shard_sql(shards: int) -> str:
    """The shard of doc_id among shards of weight 1: the highest 52 bits of md5, then the lowest number."""
    return f"(SELECT arg_max(i, (substr(md5('shard' || i || ':' || doc_id), 1, 13), -i)) FROM range({shards}) t(i))"


@query(
    f"""WITH RECURSIVE {jaccard_sql("documents", 3, 90, 100)}
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.least AS component_id, coalesce(c.first, d.doc_id) AS class_id, coalesce(l.k, 0) AS n_links
    FROM documents d LEFT JOIN counted n USING (doc_id) JOIN (SELECT x, min(y) AS least FROM reached GROUP BY x) r ON r.x = d.doc_id
    LEFT JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY d) AS first FROM same) c ON c.doc_id = d.doc_id
    LEFT JOIN (SELECT x, count(*) AS k FROM linked GROUP BY x) l ON l.x = d.doc_id"""
)
def op1_ngram_jaccard_join(spark, sf):
    return jaccard_join.jaccard_join(table(spark, sf, "documents"), words=3, num=90, den=100)


@query()
def op2_language_mixture(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(docs.filter(~language.held_out("doc_id")))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


#: The tokenizer's description, which the driver reads.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A conversation whose texts are made of another template's control strings.
TRICKY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query(
    """WITH turned AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)),
    joined AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
        sum(length(role) + length(text) + 32 + CASE WHEN conv_id = -7 THEN 3 ELSE 0 END)::BIGINT AS formatted_chars FROM turned GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined"""
)
def op3_chat_masks(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns.unionByName(tricky), tokenizer=TOKENIZER)
    return chat.digests(chats).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


@query()
def op4_benchmark_leaks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, sf, "benchmark"), words=5, least=0.8)


@query()
def op5_tiff_payloads(spark, sf):
    files = tiff.payload_files(table(spark, sf, "documents").select("doc_id", "text"))
    return tiff.joined_pages(tiff.read_pages(files), ["doc_id", "n_bytes", "media"]).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def quality_model(spark, sf):
    """Learns labels.quality from the rows that are not held out."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return quality.train(docs, labels.filter(~quality.held_out("doc_id", 5, 0)))


@query()
def op6_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality_model(spark, sf))
    return scored.select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(f"WITH {mixing_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed")
def op9_mix_sources(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query(
    f"""WITH {CRC_TABLE}, placed AS (SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size, coalesce({crc32_sql("text")}, 0) AS text_crc32,
        {shard_sql(16)}::INTEGER AS shard, {shard_sql(17)}::INTEGER AS grown_shard FROM documents, crc)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id, size, text_crc32) - 1 AS slot FROM placed"""
)
def op10_rendezvous_shards(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, weights=[1.0] * 16)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query()
def op7_main_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


SITES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def site_sql() -> str:
    """The longest site rule that fits host and path, as a struct of its length, rule and action."""
    rows = ", ".join(f"({len(r)}, '{r}', '{a}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in SITES)
    return f"""(SELECT arg_max({{'rule': r, 'action': a}}, n) FROM (VALUES {rows}) t(n, r, a, h, p)
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))"""


@query(
    rf"""WITH parted AS (SELECT page_id, coalesce(translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1) END,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path FROM pages),
    judged AS (SELECT *, {site_sql()} AS s, regexp_matches(host || path, '(^|[^A-Za-z0-9])({"|".join(p.strip("^") for _, p in url_filter.PATTERNS)})([^A-Za-z0-9]|$)') AS bad FROM parted)
    SELECT page_id, host, path, s.rule AS rule, CASE WHEN s.rule IS NOT NULL THEN s.action WHEN bad THEN 'block' ELSE 'allow' END AS verdict FROM judged"""
)
def op8_url_rules(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, SITES)).select("page_id", "host", "path", "rule", "verdict")
