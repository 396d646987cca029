"""Queries over texts: cleaning, chunks, sentences, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.html import html_text
from loomline.operators import segments
from loomline.plans.shared import REGISTRY, STRIP
from loomline.sources.tables import table, texts



def _each(c: str, patterns: list[tuple[str, str]]) -> str:
    for p, r in patterns:
        c = f"regexp_replace({c}, '{p}', '{r}', 'g')"
    return c


def _put(c: str, pairs: dict[str, str]) -> str:
    for p, r in pairs.items():
        c = "replace({}, '{}', '{}')".format(c, p, r.replace("'", "''"))
    return c


_BARE = _each(
    _put("coalesce(text, '')", T.ENTITIES),
    [(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);", "")]
    + [(rf"(?is)<\s*{b}\b[^>]*>.*?</\s*{b}\s*>", "") for b in T.BLOCKS]
    + [(r"</?[a-zA-Z][a-zA-Z0-9]*\b[^>]*?/?>", ""), (r"(?s)<!--.*?-->", ""), *((b, "") for b in T.BADGES)],
)
_SQUEEZE = [(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+", " "), (r" +\n", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")]


def _drop_latex(c: str) -> str:
    """Marks stand for the mathematics, in order, while the commands around are dropped."""
    prose = _each("p", [(k, r"\1") for k in T.LATEX_KEPT] + [(T.LATEX_DROPPED, "")])
    parts = f"string_split(regexp_replace({c}, '{T.MATH}', chr(57345), 'g'), chr(57345))"
    spans = f"list_append(regexp_extract_all({c}, '{T.MATH}'), '')"
    return _put(f"array_to_string(list_transform(list_zip(list_transform({parts}, lambda p: {prose}), {spans}), lambda z: z[1] || coalesce(z[2], '')), '')", T.LIGATURES)


_CLEAN = _each(_put(_BARE, T.KNOWN_MOJIBAKE), _SQUEEZE)
_IS_PAPER = f"lower({STRIP.format('source_type')}) IN ({', '.join(f"'{p}'" for p in T.PAPERS)})"


@REGISTRY.query("clean_documents", f"SELECT doc_id, {_CLEAN} AS clean FROM documents")
def clean_documents(spark, d):
    return texts(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@REGISTRY.query(
    "clean_by_source",
    f"WITH b AS (SELECT doc_id, source_type, {_BARE} AS bare FROM documents), c AS (SELECT doc_id, CASE WHEN {_IS_PAPER} THEN {_drop_latex('bare')} ELSE bare END AS c FROM b) SELECT doc_id, {_each(_put('c', T.KNOWN_MOJIBAKE), _SQUEEZE)} AS clean FROM c",
)
def clean_by_source(spark, d):
    return texts(spark, d, "documents").select("doc_id", T.clean_text(F.col("text"), F.col("source_type")).alias("clean"))


@REGISTRY.query("title_keys", r"SELECT doc_id, title, trim(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents")
def title_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", "title", T.for_matching(F.col("title")).alias("key"))


_WORD_CLASS = "[a-zA-Z0-9_]"
_MEND = rf"regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\b({'|'.join(T.KEPT_HYPHENS)})-\s+({_WORD_CLASS}{{2,}})', '\1-\2', 'g'), '({_WORD_CLASS}{{2,}})-\s+({_WORD_CLASS}{{2,}})', '\1\2', 'g')"


@REGISTRY.query("mend_hyphens", f"SELECT doc_id, {_MEND} AS mended FROM documents WHERE text IS NOT NULL")
def mend_hyphens(spark, d):
    return texts(spark, d, "documents").where("text is not null").select("doc_id", T.mend_hyphens(F.col("text")).alias("mended"))


_MARKERS = ", ".join([f"CASE WHEN contains(lower(text), '{m}') THEN '{m}' END" for m in T.MARKUP] + [f"CASE WHEN contains(text, '{m}') THEN '{m}' END" for m in T.DAMAGE])


@REGISTRY.query(
    "noise_markers",
    f"SELECT doc_id, unnest(list_filter([{_MARKERS}], lambda m: m IS NOT NULL)) AS marker FROM documents WHERE text IS NOT NULL",
)
def noise_markers(spark, d):
    return texts(spark, d, "documents").where("text is not null").select("doc_id", F.explode(T.noise_markers(F.col("text"))).alias("marker"))


@REGISTRY.query(
    "word_counts",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '')) AS BIGINT) AS words,
    CAST(length(coalesce(text, '')) AS BIGINT) AS characters FROM documents""",
)
def word_counts(spark, d):
    c = F.coalesce("text", F.lit(""))
    return texts(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length(c).cast("bigint").alias("characters"))


@REGISTRY.query(
    "stale_lengths",
    "SELECT doc_id, n_chars, CAST(length(text) AS BIGINT) AS characters FROM documents WHERE text IS NOT NULL AND n_chars IS DISTINCT FROM length(text)",
)
def stale_lengths(spark, d):
    rows = texts(spark, d, "documents").select("doc_id", "n_chars", F.length("text").cast("bigint").alias("characters"))
    return rows.where("characters is not null and not (n_chars <=> characters)")


@REGISTRY.query(
    "document_chunks",
    """WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    s AS (SELECT doc_id, text, n, unnest(generate_series(0, CASE WHEN n > 1000 THEN CAST(ceil(n / 800.0) AS BIGINT) - 1 ELSE 0 END)) AS i FROM t)
    SELECT doc_id, CAST(i + 1 AS INT) AS chunk_index, CAST(i * 800 AS INT) AS start_char, CAST(least(i * 800 + 1000, n) AS INT) AS end_char, substring(text, i * 800 + 1, 1000) AS text FROM s""",
)
def document_chunks(spark, d):
    return segments.chunks(texts(spark, d, "documents"), "doc_id")


@REGISTRY.query(
    "table_safe_chunks",
    r"""WITH t AS (SELECT doc_id, text, length(text) AS n, string_split(text, chr(10)) AS a FROM documents WHERE length(text) > 0),
    e AS (SELECT doc_id, n, unnest(a) AS line, unnest(generate_series(1, len(a))) AS pos FROM t),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM e),
    r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM o WHERE regexp_matches(line, '^[ \t]*\|.*\|[ \t]*$')),
    b AS (SELECT doc_id, min(first) AS s0, least(max(first + length(line) + 1), any_value(n)) AS s1 FROM r GROUP BY doc_id, island HAVING count(*) >= 2),
    s AS (SELECT doc_id, text, n, unnest(generate_series(0, CASE WHEN n > 1000 THEN CAST(ceil(n / 800.0) AS BIGINT) - 1 ELSE 0 END)) AS i FROM t),
    w AS (SELECT s.doc_id, i, any_value(text) AS text, any_value(n) AS n, max(s1) AS s1 FROM s LEFT JOIN b ON b.doc_id = s.doc_id AND s0 < i * 800 + 1000 AND i * 800 + 1000 < s1 GROUP BY s.doc_id, i),
    f AS (SELECT doc_id, i, text, greatest(least(i * 800 + 1000, n), coalesce(s1, 0)) AS e FROM w)
    SELECT doc_id, CAST(i + 1 AS INT) AS chunk_index, CAST(i * 800 AS INT) AS start_char, CAST(e AS INT) AS end_char, substring(text, i * 800 + 1, CAST(e AS BIGINT) - i * 800) AS text FROM f""",
)
def table_safe_chunks(spark, d):
    return segments.chunks(texts(spark, d, "documents"), "doc_id", whole_tables=True)


# RE2 has no look-behind: full stops within abbreviations are marked first, and the marks taken out at the end
_SPLIT = r"""list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text,
  '([A-Z][a-z]\.)([\s\x0b\x{85}\p{Z}])', '\1' || chr(57346) || '\2', 'g'), '([\pL\pN_\pM\p{Pc}]\.[\pL\pN_\pM\p{Pc}].)([\s\x0b\x{85}\p{Z}])', '\1' || chr(57346) || '\2', 'g'),
  '([.?])[\s\x0b\x{85}\p{Z}]', '\1' || chr(57345), 'g'), chr(57345)), lambda s: regexp_replace(replace(s, chr(57346), ''), '^[\s\x0b\x{85}\p{Z}]+|[\s\x0b\x{85}\p{Z}]+$', '', 'g'))"""
_SENTENCES = f"""WITH p AS (SELECT doc_id, list_filter({_SPLIT}, lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(s) AS text, unnest(generate_series(1, len(s))) AS i FROM p)
    SELECT doc_id, CAST(i AS INT) AS sentence_index, text FROM e WHERE length(text) >= 15"""


@REGISTRY.query("document_sentences", _SENTENCES)
def document_sentences(spark, d):
    return segments.sentences(texts(spark, d, "documents"), ["doc_id"])


@REGISTRY.query("sentence_numbers", f"SELECT doc_id, sentence_index, CAST(row_number() OVER (ORDER BY doc_id, sentence_index) - 1 AS BIGINT) AS number FROM ({_SENTENCES})")
def sentence_numbers(spark, d):
    rows = segments.sentences(texts(spark, d, "documents"), ["doc_id"]).drop("text")
    return segments.global_numbers(rows, "doc_id", ["sentence_index"]).select("doc_id", "sentence_index", F.col("number").cast("bigint").alias("number"))


@REGISTRY.query(
    "prose_shares",
    f"""WITH s AS ({_SENTENCES}), q AS (SELECT doc_id, text, regexp_extract(text, '[a-zA-Z]') AS f,
      coalesce(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / nullif(length(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]', '', 'g')), 0), 0.0) AS share FROM s)
    SELECT doc_id, count(*) AS sentences, count(*) FILTER (f = upper(f) AND share >= 0.6 AND NOT regexp_matches(lower(text), 'https?:|```|def |import |\\|')) AS prose FROM q GROUP BY doc_id""",
)
def prose_shares(spark, d):
    rows = segments.sentences(texts(spark, d, "documents"), ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(T.is_prose(F.col("text"))).alias("prose"))


@REGISTRY.query(
    "table_blocks",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, unnest(a) AS line, unnest(generate_series(0, len(a) - 1)) AS pos FROM l),
    r AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM e WHERE regexp_matches(line, '^[ \t]*\|.*\|[ \t]*$'))
    SELECT doc_id, CAST(min(pos) AS INT) AS first_line, CAST(max(pos) AS INT) AS last_line, count(*) AS rows FROM r GROUP BY doc_id, island HAVING count(*) >= 2""",
)
def table_blocks(spark, d):
    return segments.table_blocks(texts(spark, d, "documents"), "doc_id")


_M = "|".join(T.MONTHS)
_Y = r"(?:19|20)\d{2}"
_DATES = rf"""WITH s AS (
  SELECT DISTINCT sentence_id, sentence AS c, TRY_CAST(nullif(regexp_extract(coalesce(year, ''), '{_Y}'), '') AS INT) AS y FROM labeling_candidates_sample WHERE sentence_id IS NOT NULL AND sentence IS NOT NULL
), m AS (SELECT *, regexp_extract(c, '\b{_Y}-\d{{2}}-\d{{2}}\b') AS iso, regexp_extract(c, '(?i)\b({_M})\s+({_Y})\b') AS mon, regexp_extract(c, '(?i)\b({_M})\s+({_Y})\b', 1) AS mname,
  regexp_extract(c, '(?i)\b({_M})\s+({_Y})\b', 2) AS myear, regexp_extract(c, '(?i)\b(?:in|around|circa|since|after|before|by|during)\s+({_Y})\b') AS ctx,
  regexp_extract(c, '(?i)\b(?:in|around|circa|since|after|before|by|during)\s+({_Y})\b', 1) AS cyear, regexp_extract(c, '\b({_Y})\b') AS plain FROM s)
SELECT sentence_id, CASE WHEN iso <> '' THEN iso WHEN mon <> '' THEN mon WHEN ctx <> '' THEN ctx WHEN plain <> '' THEN plain ELSE CAST(y AS VARCHAR) END AS date_text,
  CASE WHEN iso <> '' THEN iso WHEN mon <> '' THEN myear || '-' || lpad(CAST(list_position({[m.lower() for m in T.MONTHS]}, lower(mname)) AS VARCHAR), 2, '0') WHEN ctx <> '' THEN cyear WHEN plain <> '' THEN plain ELSE CAST(y AS VARCHAR) END AS normalized_date,
  CAST(CASE WHEN iso <> '' THEN left(iso, 4) WHEN mon <> '' THEN myear WHEN ctx <> '' THEN cyear WHEN plain <> '' THEN plain ELSE CAST(y AS VARCHAR) END AS INT) AS extracted_year,
  CASE WHEN iso <> '' THEN 1.0 WHEN mon <> '' THEN 0.9 WHEN ctx <> '' THEN 0.85 WHEN plain <> '' THEN 0.7 WHEN y IS NOT NULL THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN iso <> '' THEN 'sentence_full_date' WHEN mon <> '' THEN 'sentence_month_year' WHEN ctx <> '' THEN 'sentence_context_year' WHEN plain <> '' THEN 'sentence_plain_year' WHEN y IS NOT NULL THEN 'document_year' END AS source FROM m"""


@REGISTRY.query("sentence_dates", _DATES)
def sentence_dates(spark, d):
    own = F.nullif(F.regexp_extract(F.coalesce("year", F.lit("")), r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")
    rows = table(spark, d, "labeling_candidates_sample").where("sentence_id is not null and sentence is not null")
    rows = rows.select("sentence_id", "sentence", own.alias("y")).distinct()
    return rows.select("sentence_id", T.date_struct(F.col("sentence"), F.col("y")).alias("d")).select("sentence_id", "d.*")


@REGISTRY.query(
    "papers_without_latex",
    f"WITH b AS (SELECT doc_id, {_BARE} AS bare FROM documents WHERE {_IS_PAPER}), c AS (SELECT doc_id, {_drop_latex('bare')} AS c FROM b) SELECT doc_id, {_each('c', _SQUEEZE)} AS clean FROM c",
)
def papers_without_latex(spark, d):
    papers = texts(spark, d, "documents").where(F.lower(T.strip(F.col("source_type"))).isin(*T.PAPERS))
    return papers.select("doc_id", T.squeeze(T.drop_latex(T.drop_markup(F.coalesce("text", F.lit(""))))).alias("clean"))


@REGISTRY.query("page_texts")
def page_texts(spark, d):
    pages = texts(spark, d, "documents").where(F.col("text").rlike("(?i)</?(?:div|p|table|span|a|img|br)[ />]"))
    return pages.select("doc_id", html_text(F.col("text")).alias("plain"))
