"""Queries of the training-data operators, by name, and the SQL some of them can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import copies, encode, identities, mojibake, natlang, packing, pii, splitting, term_counts
from scholia.plans.tables import table


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    tasks = table(spark, d, "tasks")
    return mojibake.find_garbled(tasks, mojibake.train(tasks, "task_id", ["text"]), "task_id", ["text", "message"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("task_id", "field").distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """Each garbled field with its encoding chain and the restored text where nothing is lost."""
    return _garbled(spark, d)


def _languages(spark: SparkSession, d: str) -> DataFrame:
    codes = sorted(r.code for r in table(spark, d, "nat_langs").select("code").where("code is not null").distinct().collect())
    files = table(spark, d, "source_files")
    return natlang.find_languages(files, natlang.train(table(spark, d, "documents"), files, codes))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("file_id", "nat_lang").distinct()


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each language's sentences in a file, and their share of the file's characters."""
    size = table(spark, d, "source_files").select("file_id", F.length("content").alias("file_chars"))
    return _languages(spark, d).join(size, "file_id").select("file_id", "nat_lang", "n_sentences", "n_chars", F.round(F.col("n_chars") / F.col("file_chars"), 4).alias("share"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.link_copies(table(spark, d, "tasks"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse_copies(table(spark, d, "tasks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return identities.pairs(identities.link(table(spark, d, "git_users")))


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the smallest id of its person or organisation."""
    return identities.link(table(spark, d, "git_users"))


def _private_fields() -> dict:
    email = F.col("git_user.email")
    # An address alone holds no other detail, and itself is no case in this field.
    return {"text": F.col("text"), "label": F.col("label"), "email": F.when(~email.rlike(r"^[\w.+'-]*@[\w.-]*$"), email)}


def _private_model(spark: SparkSession, d: str) -> pii.Model:
    tasks = table(spark, d, "tasks")
    return pii.train(tasks, "task_id", _private_fields(), F.col("git_user.name"), table(spark, d, "git_users"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find_private(table(spark, d, "tasks"), _private_model(spark, d), "task_id", _private_fields())
    return found.where((F.col("field") != "email") | F.col("kind").isin("phone", "id_number", "person_name")).select("task_id", "field", "kind").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The fields with each private detail replaced by a placeholder of its kind."""
    fields = _private_fields() | {"email": F.col("git_user.email")}
    return pii.redact(table(spark, d, "tasks"), _private_model(spark, d), "task_id", fields)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    fields = {"label": term_counts.split_terms(F.col("label")), "type": term_counts.whole_value(F.col("type"))}
    return term_counts.count_terms(table(spark, d, "tasks"), fields)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    marked = term_counts.mark_terms(_terms(spark, d), table(spark, d, "tasks").count())
    return marked.where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.mark_terms(_terms(spark, d), table(spark, d, "tasks").count())


def p6_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", F.concat_ws(" ", "terms").alias("ngram"), F.size("terms").alias("n"), "occurrences", "records")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def _limits(spark: SparkSession, d: str, purpose: str) -> list[tuple[int, int, int]]:
    rows = table(spark, d, "token_limits").where((F.col("purpose") == purpose) & F.col("max_tokens").isNotNull()).orderBy("limit_id").collect()
    return [(r.limit_id, r.max_tokens, r.overlap_tokens or 0) for r in rows]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    capacities = {i: c for i, c, _ in _limits(spark, d, "pack")}
    return packing.pack(encode.count_tokens(table(spark, d, "documents")), capacities, "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each capacity and the share of their space that is used."""
    capacities = {i: c for i, c, _ in _limits(spark, d, "pack")}
    capacity = F.element_at(F.create_map(*(F.lit(x) for i, c in capacities.items() for x in (i, c))), F.col("limit_id"))
    each = p8_containers(spark, d).where("size > 0").groupBy("limit_id", "container").agg(F.sum("size").alias("used"))
    return each.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens")).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 4))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "documents"), _limits(spark, d, "split"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_shares, p3_found, p3_records, p4_found, p4_entities, p5_found, p5_redacted, p6_found, p6_terms, p6_ngrams, p7_ids, p8_containers, p8_fill, p9_pieces)
}

_SEPARATORS = term_counts.SEPARATORS

_P6 = f"""
WITH pieces AS (
  SELECT 'label' AS field, task_id, term FROM (SELECT task_id, unnest(regexp_split_to_array(lower(label), '{_SEPARATORS}')) AS term FROM tasks WHERE label IS NOT NULL) WHERE term <> ''
  UNION ALL
  SELECT 'type', task_id, type FROM tasks WHERE type IS NOT NULL AND type <> ''
), counted AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT task_id) AS records FROM pieces GROUP BY field, term
), marked AS (
  SELECT *, CASE WHEN records > 0.02 * (SELECT count(*) FROM tasks) THEN 'common' WHEN records < 3 THEN 'rare' END AS mark FROM counted
)
"""

_P6_NGRAMS = f"""
WITH lists AS (
  SELECT 'label' AS field, task_id, list_filter(regexp_split_to_array(lower(label), '{_SEPARATORS}'), lambda x: x <> '') AS t FROM tasks WHERE label IS NOT NULL
  UNION ALL
  SELECT 'type', task_id, [type] FROM tasks WHERE type IS NOT NULL AND type <> ''
), begins AS (
  SELECT field, task_id, t, unnest(range(1, len(t) + 1)) AS p FROM lists
), grams AS (
  SELECT field, task_id, list_slice(t, p, p + n - 1) AS g, n FROM begins, (VALUES (1), (2), (3)) AS s(n) WHERE p + n - 1 <= len(t)
)
SELECT field, array_to_string(g, ' ') AS ngram, CAST(n AS INTEGER) AS n, count(*) AS occurrences, count(DISTINCT task_id) AS records FROM grams GROUP BY field, g, n
"""

ORACLES: dict[str, str] = {
    "p6_ngrams": _P6_NGRAMS,
    "p6_found": _P6 + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p6_terms": _P6 + "SELECT field, term, occurrences, records, mark FROM marked",
}
