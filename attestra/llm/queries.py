"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    jaccard_join,
    lexical_search,
    line_dedup,
    quality_classifier,
    quality_rules,
    sentencepiece_lattice,
    token_counts,
    token_files,
    toxicity,
    url_filters,
)
from attestra.llm.shared import Scratch, settled, table

#: The vocabulary files; each operator takes its file's path as a parameter.
PIECE_MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
BYTE_RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def toxic_training_rows():
    return _fold(5) != 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxic_training_rows())
    return scores.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode_documents(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item that a document holds."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_classifier.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold(4) != 2)
    return scores.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def dated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no fetch time; a day of 2024-2025 is derived from page_id."""
    day = (F.col("page_id") * 7919 % 731).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("fetched_at"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """A dated block list over the domains of the captures: some registered domains and hosts are listed, some of them
    taken off again, some listed once more. Dates follow from the domain's digest."""
    domains = captures.select(F.explode(url_filters.parents_of(url_filters.host_of(F.col("url")))).alias("domain")).distinct()
    digest = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 7), 16, 10).cast("long")
    rows = domains.withColumn("x", digest).where("x % 5 = 0")
    since = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))
    first, off, again = F.col("x") % 400, F.col("x") % 400 + 100 + F.col("x") % 90, F.col("x") % 400 + 300
    name = F.when(F.col("x") % 2 == 0, "spam").otherwise("adult")
    event = lambda day, action: F.struct(name.alias("list"), "domain", since(day).alias("dated"), F.lit(action).alias("action"))
    events = F.array(
        event(first, "add"),
        F.when(F.col("x") % 3 != 0, event(off, "remove")),
        F.when(F.col("x") % 7 == 0, event(again, "add")),
    )
    return rows.select(F.explode(F.array_compact(events)).alias("e")).select("e.*")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = dated_captures(spark, sf_dir)
    return url_filters.filter_urls(captures, dated_entries(captures)).select("page_id", "host", F.col("fetched_at").cast("string").alias("fetched_at"), "n_lists", "lists", F.col("blocked").cast("int").alias("blocked"))


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 731 AS INTEGER) AS DATE) AS fetched_at,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host
  FROM pages
), labelled AS (
  SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures WHERE host IS NOT NULL
), parents AS (
  SELECT host, array_to_string(labels[i:len(labels)], '.') AS domain
  FROM (SELECT host, labels, unnest(range(1, greatest(len(labels), 2))) AS i FROM labelled)
), listed AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 7) AS BIGINT) AS x FROM (SELECT DISTINCT domain FROM parents)
), chosen AS (
  SELECT domain, x, CASE WHEN x % 2 = 0 THEN 'spam' ELSE 'adult' END AS list FROM listed WHERE x % 5 = 0
), entries AS (
  SELECT list, domain, CAST(DATE '2024-01-01' + CAST(x % 400 AS INTEGER) AS DATE) AS dated, 'add' AS action FROM chosen
  UNION ALL
  SELECT list, domain, CAST(DATE '2024-01-01' + CAST(x % 400 + 100 + x % 90 AS INTEGER) AS DATE), 'remove' FROM chosen WHERE x % 3 <> 0
  UNION ALL
  SELECT list, domain, CAST(DATE '2024-01-01' + CAST(x % 400 + 300 AS INTEGER) AS DATE), 'add' FROM chosen WHERE x % 7 = 0
), one AS (
  SELECT list, regexp_replace(domain, '^www\.', '') AS domain, dated, max(action) AS action FROM entries GROUP BY ALL
), spans AS (
  SELECT list, domain, action, dated AS since, lead(dated) OVER (PARTITION BY list, domain ORDER BY dated) AS until FROM one
), hits AS (
  SELECT c.page_id, s.list FROM captures c JOIN parents p ON c.host = p.host
  JOIN spans s ON s.domain = p.domain AND s.action = 'add' AND s.since <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until)
), summed AS (
  SELECT page_id, count(DISTINCT list) AS n_lists, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY page_id
)
SELECT c.page_id, c.host, CAST(c.fetched_at AS VARCHAR) AS fetched_at, coalesce(s.n_lists, 0) AS n_lists, coalesce(s.lists, '') AS lists,
  CASE WHEN s.page_id IS NULL THEN 0 ELSE 1 END AS blocked
FROM captures c LEFT JOIN summed s ON c.page_id = s.page_id
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), f"{scratch.path}/orc", BYTE_BPE, end_id=2)
    digest = token_files.token_digest(token_files.read_token_files(spark, f"{scratch.path}/orc"))
    scratch.remove()
    return digest


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "byte-bpe") as scratch:
        decoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, scratch, decoded=True)
        decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
        return settled(decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark, "collocations") as scratch:
        return collocations.collocations(table(spark, sf_dir, "documents"), scratch)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, {_LOWER} AS x FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), sequences AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM sequences GROUP BY lang
), places AS (
  SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM sequences, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k
), frequent AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS j FROM frequent WHERE k > 1
), scores AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.j, l.f AS l, r.f AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM cuts c JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:j], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(p[j + 1:c.k], ' ') JOIN words ON words.lang = c.lang
), weakest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), within AS (
  SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(a) AS g FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, k, string_split(phrase, ' ') AS p, unnest(range(2, k)) AS m FROM weakest)
  ) GROUP BY ALL
)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank, w.phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM weakest w LEFT JOIN within h ON h.lang = w.lang AND h.phrase = w.phrase WHERE coalesce(g, 0) < a
QUALIFY rank <= 2000
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    with Scratch(spark, "lexical-search") as scratch:
        index = lexical_search.build_index(table(spark, sf_dir, "documents"), scratch, lexical_search.terms_to_index(items))
        found = lexical_search.search(index, items, scratch)
        return settled(found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score"))


OP13_SQL = rf"""
WITH occurrences AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL
), sizes AS (
  SELECT doc_id, count(*) AS n FROM occurrences GROUP BY doc_id
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), frequencies AS (
  SELECT term, count(*) AS df FROM counts GROUP BY term
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM asked JOIN frequencies USING (term), totals
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
  FROM weights JOIN counts USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 10
"""


OPERATORS = (
    op1_line_dedup,
    op2_toxicity,
    op3_sentencepiece,
    op4_decontamination,
    op5_quality_rules,
    op6_quality_classifier,
    op7_url_filters,
    op8_token_files,
    op9_token_counts,
    op10_ngram_jaccard,
    op11_byte_bpe,
    op12_collocations,
    op13_lexical_search,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op7_url_filters": OP7_SQL, "op12_collocations": OP12_SQL, "op13_lexical_search": OP13_SQL}
