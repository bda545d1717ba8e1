"""Line-first quality rules: judge lines, drop those that fail, reject documents that lose too much."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import BLANKS, table, without

#: A word with symbols or doubled exclamation marks.
NOISY = r"[#*$%&|<>]|!!"
#: What a line of prose may end with.
ENDINGS = ".!?:;…\"'”»)"
#: Starts of lines that only lead elsewhere, in English, German, Spanish and French; A-Z are taken in lower case.
NAVIGATION = (
    r"^(home|menu|log ?in|sign (in|up)|next( page)?|previous( page)?|back to top|skip to|read more|share this|search"
    r"|startseite|anmelden|weiterlesen|zum inhalt|inicio|iniciar sesión|leer más|accueil|se connecter|lire la suite)\b"
)
#: Phrases of lines that belong to the site and not to the text. In a line of more than BOILERPLATE_WORDS words they are part of what it says.
BOILERPLATE = (
    r"\b(all rights reserved|licensed under|released under the|copyright|cookies?|privacy policy|terms of (use|service)|subscribe to|enable javascript"
    r"|alle rechte vorbehalten|datenschutzerklärung|impressum|todos los derechos reservados|política de privacidad|tous droits réservés|mentions légales)\b"
)
BOILERPLATE_WORDS = 20
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 30
_BREAK = re.compile(r"[\x20\x09-\x0D]+")
# ASCII: word edges and cases as in SQL's regular expressions
_noisy, _navigation, _boilerplate = re.compile(NOISY), re.compile(NAVIGATION, re.ASCII), re.compile(BOILERPLATE, re.ASCII)
_LOWER = {c: c + 32 for c in range(65, 91)}

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_chars long, base_failed boolean, kept boolean, cleaned string"


def _word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in BLANKS)


def line_fails(line: str, suspect: bool = True) -> bool:
    """Whether a line with a word breaks the punctuation, navigation or boilerplate rule. suspect: whether a boilerplate phrase may be in it."""
    trimmed = line.strip(BLANKS)
    noisy, ended, lower = _noisy.search(line), trimmed[-1] in ENDINGS, trimmed.translate(_LOWER)
    leads = _navigation.search(lower)
    if not (noisy or leads or suspect) and ended:
        return False
    words = [w for w in _BREAK.split(line) if w]
    marked = sum(1 for w in words if _noisy.search(w)) if noisy else 0
    pipes = words.count("|")
    if 2 * marked > len(words) or not ended and len(words) < 4 or pipes >= 3 and 10 * pipes >= 3 * len(words) or leads and len(words) <= 6:
        return True
    return suspect and len(words) <= BOILERPLATE_WORDS and bool(_boilerplate.search(lower))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    hit = [counts[w] > 1 for w in windows]
    return sum(map(any, zip(hit + [False, False], [False] + hit + [False], [False, False] + hit)))


def assess(text: str | None) -> tuple:
    """A row of SCHEMA for one whole text; null counts as a text without words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    duplicates, lost, kept_lines = 0, 0, []
    suspect = bool(_boilerplate.search(text.translate(_LOWER)))  # phrases don't span lines
    for line in lines:
        if not line.strip(BLANKS):
            kept_lines.append(line)
            continue
        duplicates += line in seen
        seen.add(line)
        if line_fails(line, suspect):
            lost += _word_chars(line)
        else:
            kept_lines.append(line)
    chars, repeats = _word_chars(text), repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    return len(words), chars, symbols, duplicates, repeats, lost, failed, not failed and 100 * lost <= MAX_LOST_PERCENT * chars, "\n".join(kept_lines)


def _names() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def _assess(text):
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame.from_records([assess(t) for t in texts], columns=_names())

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    # not deterministic, so that a filter on a result doesn't run it a second time
    return F.pandas_udf(of, SCHEMA).asNondeterministic()(text)


def assess_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts, base_failed, kept and the cleaned text added.

    Null and empty texts have no words and fail. Every row is judged on its own whole text, so ties and repeated rows are
    judged alike; columns of docs that bear a result's name are replaced; an empty table gives no rows.
    """
    names = _names()
    rest = without(docs, names)
    return rest.withColumn("__line_rules", _assess(F.col(text_col))).select(*rest.columns, *[F.col(f"__line_rules.{n}").alias(n) for n in names])


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with the failing lines removed; the columns are those of docs, n_chars follows the text.

    Null and empty texts fail and go. Repeated rows are judged alike and all stay; ids aren't looked at. An empty table gives no rows.
    """
    judged = docs.withColumn("__line_rules", _assess(F.col(text_col))).where("__line_rules.kept")
    changed = judged.withColumn(text_col, F.col("__line_rules.cleaned"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *METRICS, "lost_chars", "base_failed", "kept")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
tri AS (SELECT doc_id, pos, word, lead(word, 1) OVER p AS w1, lead(word, 2) OVER p AS w2 FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
rep AS (SELECT doc_id, pos, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w1, w2) > 1 AS hit FROM tri),
cov AS (SELECT doc_id, pos, hit OR coalesce(lag(hit, 1) OVER p, false) OR coalesce(lag(hit, 2) OVER p, false) AS covered FROM rep WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
rw AS (SELECT doc_id, sum(covered::BIGINT)::BIGINT AS n_repeat_words FROM cov GROUP BY doc_id),
ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS nth FROM ls),
lf AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda x: regexp_matches(x, '{NOISY}'))) AS noisy, len(list_filter(ws, lambda x: x = '|')) AS pipes,
    right(ws[len(ws)], 1) AS last, array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '') AS solid,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_line FROM lw WHERE len(ws) > 0),
lj AS (SELECT doc_id, nth, length(solid) AS chars, 2 * noisy > n OR (strpos('{ENDINGS.replace("'", "''")}', last) = 0 AND n < 4) OR (pipes >= 3 AND 10 * pipes >= 3 * n)
    OR (n <= 6 AND regexp_matches(lower_line, '{NAVIGATION}')) OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower_line, '{BOILERPLATE}')) AS fails FROM lf),
la AS (SELECT doc_id, sum((nth > 1)::BIGINT)::BIGINT AS n_dup_lines, sum(CASE WHEN fails THEN chars ELSE 0 END)::BIGINT AS lost_chars FROM lj GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars
    FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id LEFT JOIN la ON la.doc_id = w.doc_id),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept FROM f
"""
