"""The numbered queries over the given tables and, where SQL can say them, their twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketweave.llm import chat, embedding_dedup, exact_dedup, fill_in_middle, html_text, licenses, mixing, near_dedup, packing, perplexity, phrases, token_files, toxicity
from ticketweave.llm.common import crc32_of_ids, shared_folder, small_batches
from ticketweave.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{root.rstrip('/')}/{name}.parquet")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_main_text")
def op1_main_text(spark: SparkSession, root: str) -> DataFrame:
    small_batches(spark)
    return html_text.extract_pages(table(spark, root, "pages"))


@query("op2_chat_format", r"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    joined AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
            sum(length(regexp_replace(regexp_replace(concat(role, chr(0), text), '\\', '\\\\', 'g'), '(<[|]|</?s>|\[/?INST\])', '\1+', 'g')) - 1 + 24) AS formatted
        FROM rows GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM joined""")
def op2_chat_format(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = rows.unionByName(extra)
    done = chat.format_conversations(rows, chat.text_part(F.col("text")))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op5_mix_sources")  # its random order is Spark's own hash: tested against a brute-force mix
def op5_mix_sources(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def _license_sql() -> str:
    tokens = licenses.template_tokens(licenses.TEMPLATES)
    rows = ", ".join(f"('{label}', [{', '.join(repr(t) for t in ts)}], {licenses.needed(len(ts), 0.8)})" for label, ts in tokens.items())
    places = ", ".join("list_filter(range(len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split())) + f") AS p{n}" for n, phrase in enumerate(licenses.PHRASES))
    named = ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(licenses.PHRASES.values()))
    token = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
    WITH low AS (SELECT row_number() OVER () AS rn, doc_id, {_LOW} AS t FROM documents),
    words AS (SELECT rn, doc_id, regexp_extract_all(t, {token}) AS w FROM low),
    placed AS (SELECT rn, doc_id, len(w) AS n_words, {places} FROM words),
    base AS (SELECT rn, doc_id, n_words, list_concat(list_concat(p0, p1), p2) AS starts, list_sort(list_filter([{named}], lambda x: x IS NOT NULL)) AS base FROM placed),
    blocks AS (SELECT rn, list_distinct(regexp_extract_all(line, {token})) AS have FROM (SELECT rn, unnest(string_split(t, chr(10))) AS line FROM low)),
    templates(label, wanted, need) AS (VALUES {rows}),
    met AS (SELECT rn, label, len(list_intersect(have, wanted)) / len(wanted) AS containment FROM blocks, templates WHERE len(list_intersect(have, wanted)) >= need),
    found AS (SELECT rn, list_distinct(list(label)) AS found, max(containment) AS best FROM met GROUP BY rn)
    SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word, array_to_string(base, ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
        CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
    FROM base LEFT JOIN found USING (rn)"""


@query("op7_license_scan", _license_sql())
def op7_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.license_scan(table(spark, root, "documents")).drop("blocks")


@query("op9_exact_dedup", f"""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        row_number() OVER (PARTITION BY {_LOW} ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256({_LOW}) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY {_LOW})""")
def op9_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, root, "documents"))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; every executor has the package installed."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_pack_windows")
def op4_pack_windows(spark: SparkSession, root: str) -> DataFrame:
    pieces = packing.pack(table(spark, root, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, root: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/token-files"
    token_files.write_token_files(table(spark, root, "documents"), folder, tokenizer_path("byte_bpe_50k.json"))
    back = token_files.read_documents(spark, folder)
    return back.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), crc32_of_ids(F.col("ids")).alias("ids_crc32"))


@query("op10_toxic_spans")
def op10_toxic_spans(spark: SparkSession, root: str) -> DataFrame:
    return toxicity.score_documents(table(spark, root, "documents"), table(spark, root, "labels")).drop("spans")


@query("op6_perplexity_bands")
def op6_perplexity_bands(spark: SparkSession, root: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, root, "documents"))


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, root, "documents"), words=3, percent=85).drop("mark")


@query("op11_phrases", rf"""
    WITH docs AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, {_LOW} AS t FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
    grams AS (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS g FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
    counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
    cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counts WHERE len(g) > 1),
    scored AS (
        SELECT c.lang, c.g, c.a, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score, k
        FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
    spans AS (SELECT lang, g, f, unnest(range(2, len(g))) AS m FROM counts WHERE len(g) > 2),
    inside AS (SELECT lang, f, unnest(list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])) AS g FROM spans),
    longer AS (SELECT lang, g, max(f) AS f FROM inside GROUP BY lang, g),
    kept AS (SELECT lowest.*, array_to_string(lowest.g, ' ') AS phrase FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.g = lowest.g WHERE longer.f IS NULL OR 100 * longer.f < 100 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept QUALIFY rank <= 2000""")
def op11_phrases(spark: SparkSession, root: str) -> DataFrame:
    return phrases.collocations(table(spark, root, "documents"))


@query("op13_fill_in_middle", r"""
    WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    numbers AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed),
    formed AS (
        SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM numbers),
    parts AS (SELECT *, substring(t, 1, low) AS p, substring(t, low + 1, high - low) AS m, substring(t, high + 1, n) AS s FROM formed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
    FROM parts""")
def op13_fill_in_middle(spark: SparkSession, root: str) -> DataFrame:
    done = fill_in_middle.restored(fill_in_middle.transform(table(spark, root, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_embedding_dedup")
def op12_embedding_dedup(spark: SparkSession, root: str) -> DataFrame:
    return embedding_dedup.near_equal_vectors(table(spark, root, "embeddings"))
