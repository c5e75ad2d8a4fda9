"""The registered queries of this subpackage: thin bindings of its operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, linededup, mixing, pii, quality, simhash, syncmers, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))  # the contract's shingles of four words and 4 bits
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> ''
  GROUP BY key HAVING count(DISTINCT coalesce('s' || source, 'null'))
                      >= CASE WHEN length(key) < {linededup.SHORT_CHARS} THEN {linededup.SHORT_SITES} ELSE {linededup.MIN_SITES} END
), marked AS (
  SELECT k.*, c.key IS NOT NULL
         AND row_number() OVER (PARTITION BY k.key ORDER BY k.doc_id, k.pos) > 1 AS lost
  FROM keyed k LEFT JOIN common c ON k.key = c.key
), joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_removed
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, j.text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_conversations(turns.unionByName(extra), then=(chat.digest_batches, chat.DIGESTS))


def _escaped(column: str) -> str:
    return f"replace(replace({column}, '\\', '\\\\'), '<|', '<\\|')"


OP5_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, who, '\\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, who)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.TURN + chat.SAYS + chat.END)} + length({_escaped("role")}) + length({_escaped("text")})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(docs, labels, {"toxic": F.col("toxic") == 1}, kinds=toxicity.KINDS)
    return toxicity.scored(docs, chain)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, profiles)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# What SQL can say of the operators above: their exact parts, through the same operators.


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6_pii."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1)::INT ELSE substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1)::INT * 2 - 9 * (substr({_DIGITS}, length({_DIGITS}) + 1 - i, 1)::INT > 4)::INT END)) % 10 = 0"
BASE_SQL = rf"""
SELECT doc_id,
  len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS HUGEINT), 999) <= 255)))) AS n_ip,
  len(list_filter(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN})) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) BETWEEN 9 AND 15)) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_syncmers says of the texts themselves."""
    return op7_syncmers(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, text), first(text) OVER (ORDER BY doc_id, text)) AS after FROM t)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 4) || left(after, length(text) // 4)) AS edited_sha256 FROM n
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op10_mixing; targets to a thousandth, since sums of doubles depend on their order."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: Sources reach their limit in the order of limit by weight; whoever comes after the last one shares what is left.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
c AS (SELECT *, (total - used)::DOUBLE / rest AS share, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS place FROM o),
f AS (SELECT min(place) AS place, arg_min(share, place) AS share FROM c WHERE share * w <= 3 * source_size)
SELECT d.doc_id, d.size, c.source_size, round(CASE WHEN f.place IS NULL OR c.place < f.place THEN 3.0::DOUBLE * c.source_size ELSE f.share * c.w END, 3) AS target
FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source CROSS JOIN f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash,
        op2_decontamination,
        op3_quality,
        op4_line_dedup,
        op5_chat_format,
        op6_pii,
        op7_syncmers,
        op8_toxicity,
        op9_language,
        op10_mixing,
        base_personal_data,
        edited_texts,
        mix_targets,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_chat_format": OP5_SQL, "base_personal_data": BASE_SQL, "edited_texts": EDITED_SQL, "mix_targets": TARGETS_SQL}
