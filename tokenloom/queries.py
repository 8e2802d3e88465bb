"""The catalogue: a query for each operator over a whole table, with SQL where SQL can say it.

Lists come back as strings joined by the unit separator, so that their hashes
can be compared across engines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import samples
from tokenloom.functions import decoders as D
from tokenloom.functions import normalizers as N
from tokenloom.functions import pretokenizers as P
from tokenloom.functions import processors as R
from tokenloom.functions.aligned import BYTE_CHARS, WS
from tokenloom.operators import lookup, models, shape
from tokenloom.plans.added import AddedToken
from tokenloom.plans.batches import spread
from tokenloom.plans.tokenizer import Padding, Tokenizer, Truncation
from tokenloom.streaming.decode import decode_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEP = "\x1f"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, over all cores also where it is small."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _joined(c: Column) -> Column:
    return F.array_join(c, SEP)


# normalizers: string to string over documents


def _replaces(expression: str, replacements: dict[str, str]) -> str:
    for old, new in replacements.items():
        expression = f"replace({expression}, {samples.sql_text(old)}, {samples.sql_text(new)})"
    return expression


def _normalizer(name: str, part: N.Normalizer, sql: str | None, before: N.Normalizer | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.col("text") if before is None else before.column(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", part.column(text).alias("normalized"))

    _add(f"norm_{name}", run, None if sql is None else f"SELECT doc_id, {sql} AS normalized FROM documents")


_LOWER = "lower(text)"
_MARKS = r"regexp_replace({}, '\p{{M}}+', '', 'g')"
_normalizer("nfc", N.NFC(), "nfc_normalize(text)", before=N.NFD())
_BYTES = "".join(c for c in "äöüßéèêëàâîïôûùçñíóúáÄÖÜÉÈÊÇÑÍÓÚÁÀœ¿¡")


def _apart_sql(expression: str) -> str:
    """Canonical decomposition by replacing the letters of these tables one by one."""
    for c in _BYTES:
        if unicodedata.decomposition(c):
            expression = f"replace({expression}, '{c}', '{unicodedata.normalize('NFD', c)}')"
    return expression


_LIGATURE = N.Replace(pattern="fi", content="\ufb01")  # so that compatibility forms have something to do
_normalizer("nfd", N.NFD(), _apart_sql("text"))
_normalizer("nfkc", N.NFKC(), "nfc_normalize(text)", before=N.Sequence(normalizers=[N.NFD(), _LIGATURE]))
_normalizer("nfkd", N.NFKD(), _apart_sql("text"), before=_LIGATURE)
_normalizer("lower", N.Lowercase(), _LOWER)
_normalizer("upper", N.Uppercase(), "replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß')")
_normalizer("strip", N.Strip(), r"regexp_replace(regexp_replace(replace(text, 'the', ' '), '^[" + WS + r"]+', ''), '[" + WS + r"]+$', '')", before=N.Replace(pattern="the", content=" "))
_normalizer("accents", N.StripAccents(), "strip_accents(text)")
_normalizer("prepend", N.Prepend(prepend="▁"), "'▁' || text")
_normalizer("replace", N.Replace(pattern={"Regex": "[aeiou]+"}, content="$1"), r"regexp_replace(text, '[aeiou]+', '$1', 'g')")
_normalizer("nmt", N.Nmt(), r"regexp_replace(regexp_replace(text, '[\x01-\x08\x0B\x0E-\x1F\x7F\x{8F}\x{9F}]', '', 'g'), '[\x09\x0A\x0C\x0D\x{1680}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2581}\x{FEFF}\x{FFFD}]', ' ', 'g')")
_BERT_CLEAN = r"regexp_replace(regexp_replace(text, '[\x00\x{FFFD}\p{Cf}\p{Co}\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '[" + WS + r"]', ' ', 'g')"
_normalizer("bert", N.BertNormalizer(), f"lower(strip_accents({_BERT_CLEAN}))")
_normalizer("sequence", N.Sequence(normalizers=[N.Strip(), N.Lowercase(), N.Replace(pattern="th", content="TH")]), r"replace(lower(regexp_replace(regexp_replace(text, '^[" + WS + r"]+', ''), '[" + WS + r"]+$', '')), 'th', 'TH')")


def _byte_sql(expression: str) -> str:
    """Byte mapping by replacing: ASCII through translate, the other letters of these tables one by one."""
    low = "".join(chr(i) for i in range(1, 0x21)) + "\x7f"
    out = f"translate({expression}, {_chars(low)}, {samples.sql_text(''.join(BYTE_CHARS[ord(c)] for c in low))})"
    for c in _BYTES:
        out = f"replace({out}, '{c}', {samples.sql_text(P.byte_encode(c))})"
    return out


def _chars(text: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in text)


_normalizer("bytelevel", N.ByteLevel(), _byte_sql("text"))
_CHARSMAP = {"é": "e", "ß": "ss", "ñ": "ny", "ü": "u\u0308", "A": "a", "...": "-", ".": "\u3002"}
_normalizer("precompiled", N.Precompiled(precompiled_charsmap=N.compile_charsmap(_CHARSMAP)), _replaces("text", {k: v for k, v in _CHARSMAP.items() if len(k) == 1}))


# pre-tokenizers: documents (or pages) to pieces


def _pretokenizer(name: str, part: P.PreTokenizer, sql: str | None, source: tuple[str, str, str] = ("documents", "doc_id", "text"), before: N.Normalizer | None = None) -> None:
    tab, key, col = source

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pieces = part.column(F.col(col) if before is None else before.column(F.col(col)))
        return table(spark, sf_dir, tab).select(key, pieces.alias("p")).select(key, F.size("p").alias("n"), _joined(F.col("p")).alias("pieces"))

    if sql is not None:
        sql = f"WITH x AS (SELECT {key}, {sql.replace('{c}', col)} AS p FROM {tab}) SELECT {key}, len(p)::INT AS n, coalesce(array_to_string(p, chr(31)), '') AS pieces FROM x"
    _add(f"pretok_{name}", run, sql)


def _all(pattern: str, c: str = "{c}") -> str:
    return f"regexp_extract_all({c}, {samples.sql_text(pattern)})"


_PAGES = ("pages", "page_id", "html")
_PUNCT = r"\p{P}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
_WORDCLASS = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}"
_WORDS_RE = f"[{_WORDCLASS}]+|[^{_WORDCLASS}{WS}]+"
_pretokenizer("bert", P.BertPreTokenizer(), _all(rf"[\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}]+|[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}{WS}]+"))
_pretokenizer("whitespace", P.Whitespace(), _all(_WORDS_RE))
_pretokenizer("wsplit", P.WhitespaceSplit(), _all(f"[^{WS}]+"))
_pretokenizer("digits_grouped", P.Digits(), _all(r"\p{Nd}+|[^\p{Nd}]+"))
_pretokenizer("digits_individual", P.Digits(individual_digits=True), _all(r"\p{Nd}|[^\p{Nd}]+"))
_pretokenizer("punct_isolated", P.Punctuation(), _all(f"[{_PUNCT}]|[^{_PUNCT}]+"), _PAGES)
_pretokenizer("punct_removed", P.Punctuation(behavior="removed"), _all(f"[^{_PUNCT}]+"), _PAGES)
_pretokenizer("punct_merged_prev", P.Punctuation(behavior="merged_with_previous"), _all(f"[^{_PUNCT}]+[{_PUNCT}]?|[{_PUNCT}]"), _PAGES)
_pretokenizer("punct_merged_next", P.Punctuation(behavior="merged_with_next"), _all(f"[{_PUNCT}](?:[^{_PUNCT}]+)?|[^{_PUNCT}]+"), _PAGES)
_pretokenizer("punct_contiguous", P.Punctuation(behavior="contiguous"), _all(f"[{_PUNCT}]|[^{_PUNCT}]+"), _PAGES)
_pretokenizer("delim", P.CharDelimiterSplit(delimiter="e"), "list_filter(string_split({c}, 'e'), lambda x: x <> '')")
_pretokenizer("split_string", P.Split(pattern="th"), "list_filter(string_split({c}, 'th'), lambda x: x <> '')")
_pretokenizer("split_regex", P.Split(pattern={"Regex": "[aeiou]"}, behavior="isolated"), _all("[aeiou]|[^aeiou]+"))
_pretokenizer("split_regex_runs", P.Split(pattern={"Regex": "[aeiou]"}, behavior="contiguous", merge_runs=True), _all("[aeiou]+|[^aeiou]+"))
_pretokenizer("fixed", P.FixedLength(length=5), _all(r"(?s:.{1,5})"))
_THREE = {"th": "дом", "in": "你好", "s": "ш"}  # Cyrillic and Han among the Latin letters
_CYRILLIC, _HAN = "\u0400-\u052f", "\u4e00-\u9fff"
_pretokenizer(
    "scripts",
    P.UnicodeScripts(),
    _all(rf"[^\p{{Latin}}{_CYRILLIC}{_HAN}]*(?:[{_CYRILLIC}][^\p{{Latin}}{_HAN}]*|[{_HAN}][^\p{{Latin}}{_CYRILLIC}]*|\p{{Latin}}[^{_CYRILLIC}{_HAN}]*)|[^\p{{Latin}}{_CYRILLIC}{_HAN}]+", _replaces("{c}", _THREE)),
    before=N.Sequence(normalizers=[N.Replace(pattern=k, content=v) for k, v in _THREE.items()]),
)
_META = "CASE WHEN {c} <> '' AND NOT starts_with(replace({c}, ' ', '▁'), '▁') THEN '▁' ELSE '' END || replace({c}, ' ', '▁')"
_pretokenizer("metaspace", P.Metaspace(), _all("▁[^▁]*|[^▁]+", _META))
_pretokenizer("metaspace_never", P.Metaspace(prepend_scheme="never"), _all("▁[^▁]*|[^▁]+", "replace({c}, ' ', '▁')"))
_pretokenizer("sequence", P.Sequence(pretokenizers=[P.WhitespaceSplit(), P.Digits(individual_digits=True)]), rf"flatten(list_transform({_all(f'[^{WS}]+')}, lambda x: {_all('[0-9]|[^0-9]+', 'x')}))")
#: White space before a word is cut before its last character, which goes with the word if it is a space.
_LEADING = "CASE WHEN text <> '' AND NOT starts_with(text, ' ') THEN ' ' ELSE '' END || text"
_CUT = rf"string_split(regexp_replace({_LEADING}, '([{WS}])([{WS}][^{WS}])', '\1' || chr(30) || '\2', 'g'), chr(30))"
_CONTRACTED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+"
_MAPPED = _byte_sql(f"array_to_string(flatten(list_transform({_CUT}, lambda x: {_all(_CONTRACTED, 'x')})), '☃')")
_add(
    "pretok_bytelevel",
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", P.ByteLevel().column(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), _joined(F.col("p")).alias("pieces")),
    f"WITH x AS (SELECT doc_id, {_MAPPED} AS p FROM documents) SELECT doc_id, CASE WHEN p = '' THEN 0 ELSE len(string_split(p, '☃')) END::INT AS n, replace(p, '☃', chr(31)) AS pieces FROM x",
)


@query("SELECT doc_id, " + _byte_sql("CASE WHEN text <> '' AND NOT starts_with(text, ' ') THEN ' ' ELSE '' END || text") + " AS together FROM documents")
def pretok_bytelevel_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the byte-level split, put together, are the mapped text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(P.ByteLevel().column(F.col("text")), "").alias("together"))


# models over documents; words are lower-cased and split by the Whitespace pattern

_WORDS_SQL = f"SELECT doc_id, i - 1 AS word_idx, w[i] AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), {samples.sql_text(_WORDS_RE)}) AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)"
_VOCAB_SQL = f"""
words AS ({_WORDS_SQL}),
vocab AS (SELECT word AS token, row_number() OVER (ORDER BY count(*) DESC, word) AS id FROM words GROUP BY word HAVING count(*) >= 2)
"""


def _document_words(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lookup.words(docs, P.Whitespace().column(N.Lowercase().column(F.col("text"))), ["doc_id", *columns])


@query(f"WITH {_VOCAB_SQL} SELECT doc_id, word_idx::INT AS word_idx, coalesce(id, 0)::BIGINT AS id FROM words LEFT JOIN vocab ON word = token")
def model_wordlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_words(spark, sf_dir)
    return lookup.word_level(rows, lookup.frequent_vocab(rows), 0).select("doc_id", "word_idx", "id")


@query(
    f"WITH {_VOCAB_SQL} SELECT lang, count(*) AS n_tokens, count(*) FILTER (WHERE id IS NULL) AS n_unknown, count(DISTINCT coalesce(id, 0)) AS n_ids FROM words JOIN documents USING (doc_id) LEFT JOIN vocab ON word = token GROUP BY lang"
)
def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, unknown tokens and distinct ids of each language with a word-level vocabulary."""
    rows = _document_words(spark, sf_dir, "lang")
    out = lookup.word_level(rows, lookup.frequent_vocab(rows), 0)
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("id") == 0).alias("n_unknown"), F.countDistinct("id").alias("n_ids"))


@query(f"WITH {_VOCAB_SQL} SELECT doc_id, avg(CASE WHEN id IS NULL THEN 1.0 ELSE 0.0 END) AS unk_rate FROM words LEFT JOIN vocab ON word = token GROUP BY doc_id")
def unk_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_words(spark, sf_dir)
    out = lookup.word_level(rows, lookup.frequent_vocab(rows), 0)
    return out.groupBy("doc_id").agg(F.avg((F.col("id") == 0).cast("double")).alias("unk_rate"))


@query(f"WITH words AS ({_WORDS_SQL}) SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, word LIMIT 100")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _document_words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(100)


def _tokenizer(model: models.Model, **parts: Any) -> Tokenizer:
    return Tokenizer(model, normalizer=N.Lowercase(), pre_tokenizer=P.Whitespace(), **parts)


def _bpe(**options: Any) -> models.BPE:
    return models.BPE(vocab=samples.BPE_VOCAB, merges=samples.BPE_MERGES, **options)


def _ids(tok: Tokenizer) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = tok.ids_frame(table(spark, sf_dir, "documents"), columns=["doc_id"])
        return out.select("doc_id", F.size("ids").alias("n"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))

    return run


_GROUPED = "SELECT doc_id, coalesce(sum(len(ids)), 0)::INT AS n, coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY word_idx) FILTER (WHERE len(ids) > 0), '') AS ids FROM documents LEFT JOIN (SELECT doc_id, word_idx, ids FROM words JOIN tokenized USING (word)) USING (doc_id) GROUP BY doc_id"


def _bpe_sql(start: str, vocab: dict[str, int] = samples.BPE_VOCAB) -> str:
    ranks = samples.sql_map({f"{a} {b}": i for i, (a, b) in enumerate(samples.BPE_MERGES)})
    return f"""
WITH RECURSIVE r AS (SELECT {ranks} AS ranks, {samples.sql_map(vocab)} AS vocab),
words AS ({_WORDS_SQL}),
merged(word, s, step) AS (
  SELECT word, {start}, 0 FROM (SELECT DISTINCT word FROM words), r
  UNION ALL
  SELECT word, s[: best.i - 1] || [s[best.i] || s[best.i + 1]] || s[best.i + 2 :], step + 1
  FROM (SELECT word, s, step, list_min(list_filter(list_transform(range(1, len(s)), lambda i: {{'rank': ranks[s[i] || ' ' || s[i + 1]], 'i': i}}), lambda x: x.rank IS NOT NULL)) AS best FROM merged, r)
  WHERE best IS NOT NULL
),
tokenized AS (SELECT word, list_transform(arg_max(s, step), lambda x: any_value_vocab[x]) AS ids FROM merged, (SELECT vocab AS any_value_vocab FROM r) GROUP BY word, any_value_vocab)
{_GROUPED}
"""


_SYMBOLS = "list_transform(regexp_extract_all(word, '(?s:.)'), lambda c: CASE WHEN vocab[c] IS NULL THEN '<unk>' ELSE c END)"
_add("model_bpe", _ids(_tokenizer(_bpe(unk_token="<unk>"))), _bpe_sql(_SYMBOLS))
_add("model_bpe_drops_unknown", _ids(_tokenizer(_bpe())), _bpe_sql("list_filter(regexp_extract_all(word, '(?s:.)'), lambda c: vocab[c] IS NOT NULL)"))
_add(
    "model_bpe_ignore_merges",
    _ids(_tokenizer(_bpe(unk_token="<unk>", ignore_merges=True))),
    f"WITH r AS (SELECT {samples.sql_map(samples.BPE_VOCAB)} AS vocab), words AS ({_WORDS_SQL}), tokenized AS (SELECT word, CASE WHEN vocab[word] IS NOT NULL THEN [vocab[word]] ELSE list_transform(regexp_extract_all(word, '(?s:.)'), lambda c: coalesce(vocab[c], 0)) END AS ids FROM (SELECT DISTINCT word FROM words), r) {_GROUPED}",
)
_BYTE_SYMBOLS = "flatten(list_transform(regexp_extract_all(word, '(?s:.)'), lambda c: CASE WHEN vocab[c] IS NOT NULL THEN [c] ELSE list_transform(range(1, strlen(c) + 1), lambda i: '<0x' || substring(hex(c), 2 * i - 1, 2) || '>') END))"
_BYTE_VOCAB = {models.byte_token(b): 1000 + b for b in range(256)}
_add("model_bpe_fallback", _ids(_tokenizer(models.BPE(vocab=samples.BPE_VOCAB | _BYTE_VOCAB, merges=samples.BPE_MERGES, byte_fallback=True, unk_token="<unk>"))), _bpe_sql(_BYTE_SYMBOLS, samples.BPE_VOCAB | _BYTE_VOCAB))
_add(
    "model_wordpiece",
    _ids(_tokenizer(models.WordPiece(vocab=samples.WORDPIECE_VOCAB))),
    f"""
WITH RECURSIVE r AS (SELECT {samples.sql_map(samples.WORDPIECE_VOCAB)} AS vocab),
words AS ({_WORDS_SQL}),
steps(word, pos, ids) AS (
  SELECT word, 0, []::INT[] FROM (SELECT DISTINCT word FROM words)
  UNION ALL
  SELECT word, hit.e, ids || [hit.id] FROM (
    SELECT word, pos, ids, list_max(list_filter(list_transform(range(pos + 1, least(length(word), pos + 12) + 1), lambda e: {{'e': e, 'id': vocab[CASE WHEN pos > 0 THEN '##' ELSE '' END || substring(word, (pos + 1)::BIGINT, e - pos)]}}), lambda x: x.id IS NOT NULL)) AS hit
    FROM steps, r WHERE pos < length(word)
  ) WHERE hit IS NOT NULL
),
tokenized AS (SELECT word, CASE WHEN max(pos) = length(word) AND length(word) <= 100 THEN arg_max(ids, pos) ELSE [1] END AS ids FROM steps GROUP BY word)
{_GROUPED}
""",
)
_UNIGRAM = Tokenizer(models.Unigram(vocab=samples.UNIGRAM_VOCAB, unk_id=0), normalizer=N.Lowercase(), pre_tokenizer=P.Metaspace(), decoder=D.Metaspace(prepend_scheme="never"))
_PIECE_IDS, _PIECE_SCORES, _LONGEST = _UNIGRAM.model.index, {t: _UNIGRAM.model.scores[i][1] for t, i in _UNIGRAM.model.index.items()}, max(len(t) for t in _UNIGRAM.model.index)
#: The best way to each place, from those to the places before; of equal scores the longest last piece.
_add(
    "model_unigram",
    _ids(_UNIGRAM),
    f"""
WITH RECURSIVE r AS (SELECT {samples.sql_map(_PIECE_IDS)} AS ids, map([{", ".join(map(samples.sql_text, _PIECE_SCORES))}], [{", ".join(f"({x!r})::DOUBLE" for x in _PIECE_SCORES.values())}]) AS scores, ({_UNIGRAM.model.unk_score!r})::DOUBLE AS unk),
words AS (SELECT doc_id, i - 1 AS word_idx, w[i] AS word FROM (SELECT doc_id, regexp_extract_all(CASE WHEN text <> '' AND NOT starts_with(replace(lower(text), ' ', '▁'), '▁') THEN '▁' ELSE '' END || replace(lower(text), ' ', '▁'), '▁[^▁]*|[^▁]+') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)),
steps(word, i, best) AS (
  SELECT word, 0, [{{'s': 0.0::DOUBLE, 'l': 0::BIGINT, 'p': []::BIGINT[]}}] FROM (SELECT DISTINCT word FROM words)
  UNION ALL
  SELECT word, i, best || [{{'s': top.s, 'l': top.l, 'p': CASE WHEN top.id = 0 AND best[i - top.l + 1].p[-1] IS NOT DISTINCT FROM 0 THEN best[i - top.l + 1].p ELSE best[i - top.l + 1].p || [top.id] END}}]
  FROM (
    SELECT word, i + 1 AS i, best, list_max(list_filter(list_transform(range(1, least(i + 1, {_LONGEST}) + 1), lambda j: {{
      's': best[i + 2 - j].s + CASE WHEN ids[substring(word, i + 2 - j, j)] IS NOT NULL THEN scores[substring(word, i + 2 - j, j)] WHEN j = 1 THEN unk ELSE NULL END,
      'l': j, 'id': coalesce(ids[substring(word, i + 2 - j, j)], 0)::BIGINT}}), lambda x: x.s IS NOT NULL)) AS top
    FROM steps, r WHERE i < length(word)
  )
),
tokenized AS (SELECT word, arg_max(best[-1].p, i) AS ids FROM steps GROUP BY word)
{_GROUPED}
""",
)


@query()
def unigram_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every distinct word of the benchmark."""
    rows = lookup.words(table(spark, sf_dir, "benchmark"), P.Whitespace().column(N.Lowercase().column(F.col("text"))), ["item_id"]).select("word").distinct()
    model = models.Unigram(vocab=samples.UNIGRAM_VOCAB, unk_id=0)

    @F.pandas_udf("array<struct<pieces:string,score:double>>")
    def best(s):  # noqa: ANN001, ANN202
        return s.map(lambda w: [{"pieces": " ".join(p), "score": x} for p, x in model.nbest_pieces(w, 3)])

    return rows.select("word", F.posexplode(best("word")).alias("rank", "b")).select("word", "rank", "b.pieces", F.round("b.score", 6).alias("score"))


# vocabulary and added tokens

_ADDED = [AddedToken("the", single_word=True), AddedToken("<mark>", special=True), AddedToken("tion", lstrip=True)]


@query(f"WITH {_VOCAB_SQL}, added(token, id) AS (VALUES ('the', 900001), ('<mark>', 900002)) SELECT token, id FROM vocab WHERE token NOT IN (SELECT token FROM added) UNION ALL SELECT token, id FROM added")
def vocab_with_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = lookup.frequent_vocab(_document_words(spark, sf_dir))
    added = spark.createDataFrame([("the", 900001), ("<mark>", 900002)], "token string, id bigint")
    return lookup.vocab_with_added(vocab, added)


@query(f"WITH {_VOCAB_SQL} SELECT DISTINCT w.word AS token, v.id, b.token AS back FROM words w LEFT JOIN vocab v ON w.word = v.token LEFT JOIN vocab b ON v.id = b.id")
def token_id_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lookup.counted_words(_document_words(spark, sf_dir)).persist()  # once, for the vocabulary and for the words
    vocab = lookup.ranked_vocab(counted)
    ids = lookup.token_to_id(counted.select("token"), vocab)
    back = lookup.id_to_token(ids.withColumnRenamed("token", "word"), vocab)
    return back.select(F.col("word").alias("token"), "id", F.col("token").alias("back"))


@query("SELECT doc_id, len(regexp_extract_all(text, '<mark>|tion'))::INT AS n FROM documents")
def added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens found in every document, special ones included."""
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0}), added_tokens=_ADDED[1:], encode_special_tokens=True)
    out = tok.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"], offsets="none", fields=("ids",))
    return out.select("doc_id", F.size(F.filter("encoding.ids", lambda i: i > 0)).alias("n"))


@query("SELECT doc_id, coalesce(len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: w = 'the')), 0)::INT AS n FROM documents")
def added_single_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0}), added_tokens=_ADDED[:1])
    out = tok.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"], offsets="none", fields=("ids",))
    return out.select("doc_id", F.size(F.filter("encoding.ids", lambda i: i > 0)).alias("n"))


# special tokens, truncation, windows, padding: code points as ids stand for tokens

_CODES = "list_transform(regexp_extract_all({}, '(?s:.)'), lambda c: unicode(c)::BIGINT)"


def _codes(c: Column) -> Column:
    """Ids of words: their lengths."""
    return F.transform(P.Whitespace().column(c), lambda w: F.length(w).cast("bigint"))


def _codes_sql(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {samples.sql_text(_WORDS_RE)}), lambda w: length(w)::BIGINT)"


def _text(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), " ", "-")


def _sql_list(c: str) -> str:
    return f"coalesce(array_to_string(list_transform({c}, lambda x: coalesce(x::VARCHAR, '-')), ' '), '')"


_TURNS = "SELECT a.conv_id, a.turn, {a} AS a, {b} AS b FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next of its conversation, as ids."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", _codes(F.col("text")).alias("a"), _codes(F.col("reply")).alias("b"))


_PROCESSORS = {
    "bert": (R.BertProcessing(), "[101] || a || [102]", "[0] || z(a) || [0]", "[101] || a || [102] || b || [102]", "[0] || z(a) || [0] || o(b) || [1]"),
    "roberta": (R.RobertaProcessing(), "[0] || a || [2]", "[0] || z(a) || [0]", "[0] || a || [2, 2] || b || [2]", "[0] || z(a) || [0, 0] || z(b) || [0]"),
    "template": (
        R.TemplateProcessing(single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", special_tokens={"[CLS]": {"ids": [7, 8], "tokens": ["[CLS]", "[C2]"]}, "[SEP]": {"ids": [9], "tokens": ["[SEP]"]}}),
        "[7, 8] || a || [9]", "[0, 0] || z(a) || [0]", "[7, 8] || a || [9] || b || [9]", "[0, 0] || z(a) || [0] || o(b) || [1]",
    ),
    "bytelevel": (R.ByteLevelProcessing(), "a", "z(a)", "a || b", "z(a) || o(b)"),
}


def _macro(s: str) -> str:
    for n, v in (("z", 0), ("o", 1)):
        for c in "ab":
            s = s.replace(f"{n}({c})", f"list_transform({c}, lambda x: {v}::BIGINT)")
    return s.replace("[0", "[0::BIGINT").replace("[1]", "[1::BIGINT]").replace("0::BIGINT, 0]", "0::BIGINT, 0::BIGINT]")


def _post(name: str, single: bool) -> None:
    processor, ids1, types1, ids2, types2 = _PROCESSORS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _turns(spark, sf_dir)
        made = shape.with_specials(F.col("a"), None if single else F.col("b"), processor)
        return rows.select("conv_id", "turn", made.alias("e")).select("conv_id", "turn", _text(F.col("e.ids")).alias("ids"), _text(F.col("e.type_ids")).alias("type_ids"))

    ids, types = (ids1, types1) if single else (ids2, types2)
    source = _TURNS.format(a=_codes_sql("a.text"), b=_codes_sql("b.text"))
    _add(f"post_{name}_{'single' if single else 'pair'}", run, f"WITH x AS ({source}) SELECT conv_id, turn, {_sql_list(ids)} AS ids, {_sql_list(_macro(types))} AS type_ids FROM x")


for _n in _PROCESSORS:
    _post(_n, True)
    _post(_n, False)

_DOC_IDS = f"SELECT doc_id, {_codes_sql('text')} AS a FROM documents"


def _doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _codes(F.col("text")).alias("a"))


def _shaped(name: str, make: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _doc_ids(spark, sf_dir).select("doc_id", _text(make()).alias("ids"))

    _add(name, run, f"WITH x AS ({_DOC_IDS}) SELECT doc_id, {_sql_list(sql)} AS ids FROM x")


_shaped("trunc_right", lambda: shape.truncate(F.col("a"), 128), "a[:128]")
_shaped("trunc_left", lambda: shape.truncate(F.col("a"), 128, "Left"), "a[greatest(len(a) - 127, 1) :]")
_shaped("pad_fixed", lambda: shape.pad(F.col("a"), 256, F.lit(0).cast("bigint")), "a || list_transform(range(greatest(256 - len(a), 0)), lambda x: 0::BIGINT)")
_shaped("pad_left", lambda: shape.pad(F.col("a"), 256, F.lit(0).cast("bigint"), "Left"), "list_transform(range(greatest(256 - len(a), 0)), lambda x: 0::BIGINT) || a")
_shaped("pad_multiple", lambda: shape.pad(F.col("a"), shape.rounded(F.size("a"), 64), F.lit(0).cast("bigint")), "a || list_transform(range((64 - len(a) % 64) % 64), lambda x: 0::BIGINT)")


@query(f"WITH x AS (SELECT item_id, {_codes_sql('text')} AS a FROM benchmark), m AS (SELECT max(len(a)) AS n FROM x) SELECT item_id, {_sql_list('a || list_transform(range(n - len(a)), lambda x: 0::BIGINT)')} AS ids FROM x, m")
def pad_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", _codes(F.col("text")).alias("ids"))
    return shape.pad_batch(rows, ["ids"]).select("item_id", _text(F.col("ids")).alias("ids"))


@query(
    f"""WITH x AS ({_DOC_IDS}), s AS (SELECT doc_id, a, unnest(range(0, 1 + CASE WHEN len(a) > 128 THEN CEIL((len(a) - 128) / 96.0)::BIGINT ELSE 0 END)) AS k FROM x)
SELECT doc_id, k::INT AS window_index, {_sql_list('a[k * 96 + 1 : k * 96 + 128]')} AS ids FROM s"""
)
def stride_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.stride_windows(_doc_ids(spark, sf_dir), "a", 128, 32)
    return rows.select("doc_id", "window_index", _text(F.col("window")).alias("ids"))


@query(
    f"""WITH x AS ({_DOC_IDS}), s AS (SELECT doc_id, a, unnest(range(0, 1 + CASE WHEN len(a) > 128 THEN CEIL((len(a) - 128) / 96.0)::BIGINT ELSE 0 END)) AS k FROM x)
SELECT doc_id, k::INT AS window_index, {_sql_list('a[greatest(len(a) - k * 96 - 128, 0) + 1 : len(a) - k * 96]')} AS ids FROM s"""
)
def stride_windows_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shape.stride_windows(_doc_ids(spark, sf_dir), "a", 128, 32, "Left")
    return rows.select("doc_id", "window_index", _text(F.col("window")).alias("ids"))


def _pairs(name: str, strategy: str, keep_a: str, keep_b: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = shape.truncate_pair(F.col("a"), F.col("b"), 64, strategy)
        return _turns(spark, sf_dir).select("conv_id", "turn", _text(a).alias("a"), _text(b).alias("b"))

    source = _TURNS.format(a=_codes_sql("a.text"), b=_codes_sql("b.text"))
    _add(name, run, f"WITH x AS ({source}), n AS (SELECT *, len(a) AS na, len(b) AS nb, 64 AS m FROM x), k AS (SELECT *, {keep_a} AS ka, {keep_b} AS kb FROM n) SELECT conv_id, turn, {_sql_list('a[:ka]')} AS a, {_sql_list('b[:kb]')} AS b FROM k")


_pairs("trunc_longest_first_pair", "LongestFirst", "CASE WHEN na + nb <= m THEN na WHEN least(na, nb) >= m // 2 THEN CASE WHEN na > nb THEN m // 2 + m % 2 ELSE m // 2 END WHEN na > nb THEN m - nb ELSE na END", "CASE WHEN na + nb <= m THEN nb WHEN least(na, nb) >= m // 2 THEN CASE WHEN na > nb THEN m // 2 ELSE m // 2 + m % 2 END WHEN na > nb THEN nb ELSE m - na END")
_pairs("trunc_only_first", "OnlyFirst", "greatest(na - greatest(na + nb - m, 0), 0)", "nb")
_pairs("trunc_only_second", "OnlySecond", "na", "greatest(nb - greatest(na + nb - m, 0), 0)")

# offsets, position maps, merging: word pieces of the benchmark

_PLACES = Tokenizer(models.WordLevel(vocab={"<unk>": 0}), pre_tokenizer=P.Whitespace())
_PLACE_SQL = f"""
WITH p AS (SELECT doc_id, text, i - 1 AS pos, w, i FROM (SELECT doc_id, text, regexp_extract_all(text, {samples.sql_text(_WORDS_RE)}) AS w, regexp_split_to_array(text, {samples.sql_text(_WORDS_RE)}) AS g FROM documents), unnest(range(1, len(w) + 1)) AS u(i)),
g AS (SELECT doc_id, i, length(w[i]) AS n, length(g) AS gap FROM (SELECT doc_id, i, w, s[i] AS g FROM (SELECT doc_id, regexp_extract_all(text, {samples.sql_text(_WORDS_RE)}) AS w, regexp_extract_all(text, {samples.sql_text(f'([{WS}]*)(?:{_WORDS_RE})')}, 1) AS s FROM documents), unnest(range(1, len(w) + 1)) AS u(i))),
o AS (SELECT doc_id, (i - 1)::INT AS pos, (sum(n + gap) OVER (PARTITION BY doc_id ORDER BY i))::INT AS "end", n FROM g)
"""
_PLACE_SQL = "WITH " + _PLACE_SQL[_PLACE_SQL.index("g AS (SELECT doc_id, i, length(w[i])") :]


@query(_PLACE_SQL + 'SELECT doc_id, pos, ("end" - n)::INT AS start, "end" FROM o')
def encode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token in its document, from the encoder."""
    rows = shape.tall(_PLACES.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"], fields=("offsets",)), keys=["doc_id"])
    return rows.select("doc_id", "pos", "start", "end")


@query(_PLACE_SQL + 'SELECT doc_id, pos, strlen(substring(text, 1, "end" - n))::INT AS start, strlen(substring(text, 1, "end"))::INT AS "end" FROM o JOIN documents USING (doc_id)')
def encode_byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token in its document, in UTF-8 bytes."""
    rows = shape.tall(_PLACES.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"], offsets="byte", fields=("offsets",)), keys=["doc_id"])
    return rows.select("doc_id", "pos", "start", "end")


_THE_SQL = f"list_transform(regexp_extract_all(lower(text), {samples.sql_text(_WORDS_RE)}), lambda w: CASE WHEN w = 'the' THEN 1 ELSE 0 END::BIGINT)"


@query(f"WITH x AS (SELECT doc_id, {_THE_SQL} AS a FROM documents) SELECT doc_id, {_sql_list('[101::BIGINT] || a[:126] || [102::BIGINT]')} AS ids FROM x")
def encode_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document cut to 128 with their special tokens; encoding stops early."""
    tok = _tokenizer(models.WordLevel(vocab={"<unk>": 0, "the": 1}), post_processor=R.BertProcessing(), truncation=Truncation(128))
    rows = tok.ids_frame(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return rows.select("doc_id", _text(F.col("ids")).alias("ids"))


@query(_PLACE_SQL + 'SELECT d.doc_id, max(pos)::INT AS token FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id AND "end" - n <= 100 AND 100 < "end" GROUP BY d.doc_id')
def map_char_to_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token at character 100 of every document, null in white space."""
    rows = _PLACES.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"], fields=("offsets",))
    return rows.select("doc_id", shape.char_to_token(F.col("encoding.offsets"), F.lit(100)).alias("token"))


@query(_PLACE_SQL + 'SELECT d.doc_id, ("end" - n)::INT AS start, "end" FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id AND pos = 5')
def map_word_to_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of word 5 of every document."""
    rows = _PLACES.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"], fields=("offsets", "word_ids"))
    span = shape.word_to_chars(F.col("encoding.offsets"), F.col("encoding.word_ids"), F.lit(5))
    return rows.select("doc_id", span.alias("s")).select("doc_id", "s.start", "s.end")


@query(_PLACE_SQL + 'SELECT d.doc_id, 2 * count(pos)::INT AS n, (2 * coalesce(max("end"), 0))::INT AS last FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id')
def merge_growing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's encoding merged with itself, offsets going on."""
    rows = _PLACES.encode_frame(table(spark, sf_dir, "documents"), columns=["doc_id"])
    merged = shape.merge_encodings(F.col("encoding"), F.col("encoding"), True)
    return rows.select("doc_id", merged.alias("m")).select("doc_id", F.size("m.ids").alias("n"), F.coalesce(F.try_element_at("m.offsets", F.lit(-1))["end"], F.lit(0)).alias("last"))


@query()
def encode_pair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next, encoded as a truncated pair with special tokens and windows."""
    c = table(spark, sf_dir, "conversations")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    tok = _tokenizer(models.WordPiece(vocab=samples.WORDPIECE_VOCAB), post_processor=R.BertProcessing(sep=("[SEP]", 3), cls=("[CLS]", 2)), truncation=Truncation(64, 8), padding=Padding(64))
    rows = tok.encode_frame(c.join(after, ["conv_id", "turn"]), pair_col="reply", columns=["conv_id", "turn"], offsets="none", fields=("ids", "type_ids", "attention_mask"))
    e = F.col("encoding")
    return rows.select("conv_id", "turn", "window_index", _text(e["ids"]).alias("ids"), _text(e["type_ids"]).alias("type_ids"), _text(e["attention_mask"]).alias("attention"))


@query(f"WITH words AS ({_WORDS_SQL}) SELECT d.doc_id, count(word)::INT AS n, (count(word) FILTER (WHERE word = 'the'))::INT AS n_the FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id GROUP BY d.doc_id")
def encode_pretokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are split already, looked up without normalizing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", P.Whitespace().column(N.Lowercase().column(F.col("text"))).alias("words"))
    tok = Tokenizer(models.WordLevel(vocab={"<unk>": 0, "the": 1}))
    rows = tok.encode_frame(docs, "words", columns=["doc_id"], words=True, fields=("ids",))
    return rows.select("doc_id", F.size("encoding.ids").alias("n"), F.size(F.filter("encoding.ids", lambda i: i == 1)).alias("n_the"))


# decoders over the words of documents

_TOKENS = f"regexp_extract_all(text, {samples.sql_text(_WORDS_RE)})"


def _decoder(name: str, part: D.Decoder, sql: str | None, tokens: Callable[[Column], Column] | None = None, tokens_sql: str = _TOKENS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pieces = (tokens or P.Whitespace().column)(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", part.column(pieces).alias("decoded"))

    if sql is not None:
        sql = f"WITH x AS (SELECT doc_id, {tokens_sql} AS t FROM documents), y AS (SELECT doc_id, {sql} AS p FROM x) SELECT doc_id, coalesce(array_to_string(p, ''), '') AS decoded FROM y"
    _add(f"decode_{name}", run, sql)


_decoder("bpe", D.BPEDecoder(suffix="e"), "list_transform(t, lambda x, i: CASE WHEN instr(x, 'e') = 0 THEN x ELSE substring(x, 1, instr(x, 'e') - 1) || CASE WHEN i = len(t) THEN '' ELSE ' ' END || substring(x, instr(x, 'e') + 1) END)")
_WP = "CASE WHEN i = 1 THEN x WHEN starts_with(x, 'th') THEN substring(x, 3) ELSE ' ' || x END"
for _a, _b in D.CONTRACTIONS:
    _WP = f"replace({_WP}, {samples.sql_text(_a)}, {samples.sql_text(_b)})"
_decoder("wordpiece", D.WordPiece(prefix="th"), f"""list_transform(t, lambda x, i: regexp_replace(regexp_replace({_WP}, ' ([.,!?;:)\\]}}''"/\\\\\\-%])', '\\1', 'g'), ' {{2,}}', ' ', 'g'))""")
_decoder("metaspace", D.Metaspace(), "list_transform(t, lambda x, i: CASE WHEN i = 1 AND NOT starts_with(x, '▁') THEN ' ' ELSE '' END || replace(x, '▁', ' '))", P.Metaspace(prepend_scheme="never").column, _all("▁[^▁]*|[^▁]+", "replace(text, ' ', '▁')"))
_decoder("ctc", D.CTC(pad_token="a", word_delimiter_token="e", cleanup=False), "list_filter(list_transform(list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]), lambda x: replace(replace(x, 'a', ''), 'e', ' ')), lambda x: x <> '')", P.FixedLength(length=1).column, _all("(?s:.)", "text"))
_decoder("fuse", D.Fuse(), "t")
_decoder("strip", D.Strip(content="t", start=1, stop=1), "list_transform(t, lambda x: regexp_replace(regexp_replace(x, '^t', ''), 't$', ''))")
_decoder("replace", D.Replace(pattern={"Regex": "([aeiou])n"}, content="<$1>"), r"list_transform(t, lambda x: regexp_replace(x, '([aeiou])n', '<\1>', 'g'))")
_decoder("sequence", D.Sequence(decoders=[D.Strip(content="t", start=1, stop=0), D.Replace(pattern="he", content="HE"), D.Fuse()]), "list_transform(t, lambda x: replace(regexp_replace(x, '^t', ''), 'he', 'HE'))")
_decoder("bytelevel", D.ByteLevel(), "t", P.ByteLevel(add_prefix_space=False).column, "[text]")
_decoder("bytefallback", D.ByteFallback(), "t", lambda c: F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit(".."), F.lit(0)), lambda b: F.concat(F.lit("<0x"), b, F.lit(">"))), "[text]")


@query("SELECT doc_id, text AS decoded FROM documents")
def decode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, decoded to the document."""
    tok = Tokenizer(models.BPE(vocab={c: b for b, c in enumerate(BYTE_CHARS)}, merges=[]), pre_tokenizer=P.ByteLevel(add_prefix_space=False), decoder=D.ByteLevel())
    return tok.decode_frame(tok.ids_frame(table(spark, sf_dir, "documents"), columns=["doc_id"])).select("doc_id", "decoded")


@query("SELECT item_id, text FROM benchmark")
def decode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ids of every benchmark text, one by one; the chunks put together are the text."""
    tok = Tokenizer(models.BPE(vocab={c: b for b, c in enumerate(BYTE_CHARS)}, merges=[]), pre_tokenizer=P.ByteLevel(add_prefix_space=False), decoder=D.ByteLevel())
    ids = tok.ids_frame(table(spark, sf_dir, "benchmark"), columns=["item_id"]).select(F.col("item_id").alias("stream_id"), F.posexplode("ids").alias("seq", "token_id"))
    chunks = decode_rows(ids.withColumn("seq", F.col("seq").cast("bigint")), tok).where("chunk is not null")
    return chunks.groupBy(F.col("stream_id").alias("item_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("text"))


@query()
def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal repeats of at least five characters in every benchmark text, from its suffix array."""

    @F.pandas_udf("array<struct<offset:int,length:int,frequency:int>>")
    def repeats(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: [{"offset": o, "length": n, "frequency": f} for o, n, f in lookup.repeated_substrings(t, 5)], na_action="ignore")

    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(repeats("text")).alias("r")).select("item_id", "r.*")

