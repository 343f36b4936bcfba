"""Queries of the core operators over the driver's tables, and the SQL they are compared with.

Every query runs over whole tables. SQL is left out where it can't express an operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import lexattrs as L
from lexiflow.functions.chars import ODD_DIGITS, SPACE
from lexiflow.operators import docs as D
from lexiflow.operators import lexeme, lm, tokenize, vocab
from lexiflow.operators.rules import DEFAULT, TokenizerRules, norm_of
from lexiflow.operators.segment import SEGMENT, segment_rows, segment_texts
from lexiflow.plans.lineage import cut_table, scratch
from lexiflow.plans.oracle import token_ctes
from lexiflow.sources import textsplits
from lexiflow.sources.tables import read_table
from lexiflow.sources.textsplits import SPLITS, TextDatasetMeta, split_of_table
from lexiflow.streaming.tokens import windowed_counts

#: Stop words of the filter and flag queries; any list can be given.
STOPS = ["the", "a", "of", "and", "in", "to", "one", "this", "that", "le", "la", "die", "das", "el", "o"]
BPTT_LEN, BATCH_SIZE = 32, 16
NO_RULES = TokenizerRules((), (), (), {})
#: Rules of the query for custom rules: single signs, so that plain SQL can say what comes out.
CUSTOM = TokenizerRules(prefixes=[r"\(", '"', "<", "-"], suffixes=[r"\)", ">", ",", r"\.", ":", ";", "!", r"\?"], infixes=["~"], exceptions={})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_rows(_documents(spark, sf_dir), "doc_id", "text")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as arrays; documents without any are left out."""
    return tokenize.tokenize_documents(_documents(spark, sf_dir).where("text <> ''"), rules=NO_RULES)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "tokens").select(F.col("text").alias("word")).unionByName(_table(spark, sf_dir, "vocab").select(F.col("token").alias("word")))
    return words.where("word is not null").distinct()


def split_tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces between single blanks, counted by language."""
    docs = _documents(spark, sf_dir).where("text is not null")
    tokens = docs.select("lang", F.explode(F.split("text", " ", -1)).alias("token"))
    return tokens.groupBy("lang", "token").agg(F.count("*").alias("n"))


def segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6, first part: words and white-space tokens of every document."""
    return _segments(spark, sf_dir)


def whitespace_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens by document: how many, how long, and whether the last one ends the text."""
    blank = _segments(spark, sf_dir).where(L.is_space(F.col("text")))
    return blank.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"), F.max("space_after").alias("at_end"))


def doc_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the text that a document's tokens make."""
    return _arrays(spark, sf_dir).select("doc_id", D.doc_text(F.col("tokens")).alias("text"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V6: tokens of each document, and characters of its tokens with their blanks."""
    sizes = F.aggregate("tokens", F.lit(0), lambda a, t: a + D.token_length(t))
    return _arrays(spark, sf_dir).select("doc_id", D.doc_length(F.col("tokens")).cast("long").alias("tokens"), sizes.cast("long").alias("characters"))


def token_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: the first, the tenth and the last token of each document."""
    t = F.col("tokens")
    return _arrays(spark, sf_dir).select("doc_id", *(D.token_at(t, i).getField("text").alias(n) for n, i in (("first", 0), ("tenth", 9), ("last", -1), ("third_last", -3))))


def span_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2, V7, V8, V9: texts of slices, of a slice of a slice, and a token of a span."""
    t = F.col("tokens")
    return _arrays(spark, sf_dir).select(
        "doc_id",
        D.doc_text(D.span(t, 2, 7)).alias("from_two"),
        D.doc_text(D.span(t, -5, -1)).alias("near_end"),
        D.doc_text(D.span_of_span(t, (3, 20), (-4, None))).alias("inner"),
        D.span_token(t, 3, 8, -1).getField("text").alias("span_last"),
    )


def token_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: every token of the stored token table with its blank, and its printed form."""
    token = F.struct("text", "space_after")
    return _table(spark, sf_dir, "tokens").where("text is not null").select("td_id", "token_position", D.text_with_ws(token).alias("with_ws"), D.token_repr(token).alias("printed"))


def lex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag word of every distinct token."""
    return _words(spark, sf_dir).select("word", L.flag_word(F.col("word"), STOPS).alias("flags"))


def lex_flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single flags read from the flag word, and one of them cleared."""
    words = lex_flags(spark, sf_dir)
    cleared = L.set_flag(F.col("flags"), L.Attribute.IS_OOV, False).alias("without_oov")
    return words.select("word", *(c.alias(n) for n, c in L.flag_accessors(F.col("flags")).items()), cleared)


def lex_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of every distinct token."""
    return _words(spark, sf_dir).select("word", L.word_shape(F.col("word")).alias("shape"))


def lex_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower case, first character, last three, length."""
    w = F.col("word")
    return _words(spark, sf_dir).select("word", L.lower(w).alias("lower"), L.prefix(w).alias("prefix"), L.suffix(w).alias("suffix"), L.length(w).cast("long").alias("length"))


def like_url_email_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3, L9, L10 over every distinct blank-separated piece of the documents."""
    pieces = _segments(spark, sf_dir).where(~L.is_space(F.col("text"))).select(F.col("text").alias("word")).distinct()
    w = F.col("word")
    return pieces.select("word", L.like_url(w).alias("url"), L.like_email(w).alias("email"), L.like_num(w).alias("num"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tokens without stop words, counted by path."""
    stops = spark.createDataFrame([(w,) for w in STOPS], "word string")
    kept = lexeme.without_stops(_table(spark, sf_dir, "tokens").where("text is not null"), stops)
    return kept.groupBy("data_path").agg(F.count("*").alias("n"))


def oov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the stored tokens that the saved vocabulary lacks."""
    lost = lexeme.out_of_vocabulary(_table(spark, sf_dir, "tokens").where("text is not null"), _table(spark, sf_dir, "vocab"))
    return lost.groupBy("text").agg(F.count("*").alias("n"))


def exceptions_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tokens that are an exception, as the exception's pieces; the first rule sent for a piece counts."""
    rules = _table(spark, sf_dir, "token_exceptions").groupBy("surface", "piece_no").agg(F.min_by("orth", "exc_id").alias("orth"))
    tokens = _table(spark, sf_dir, "tokens").join(rules, F.col("text") == F.col("surface"))
    return tokens.groupBy("surface", "piece_no", "orth").agg(F.countDistinct("td_id", "token_position").alias("n"))


def exception_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default exceptions with what their pieces stand for, next to how often the stored tokens have them."""
    rows = [(s, i, p, norm_of(p)) for s, pieces in DEFAULT.table.items() for i, p in enumerate(pieces)]
    known = spark.createDataFrame(rows, "surface string, piece_no int, orth string, norm string")
    counts = _table(spark, sf_dir, "tokens").groupBy(F.col("text").alias("surface")).agg(F.count("*").alias("n"))
    return known.join(counts, "surface", "left").select("surface", "piece_no", "orth", "norm", F.coalesce("n", F.lit(0)).alias("n"))


def tokenize_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 to T16 under the default rules: every token of every document."""
    return tokenize.tokenize(_documents(spark, sf_dir), "doc_id")


def tokenize_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules without the loss of what follows an empty piece between infixes."""
    return tokenize.tokenize(_documents(spark, sf_dir), "doc_id", rules=TokenizerRules(infix_gaps="keep"))


def tokenize_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as an array with their document: number of tokens, and the text they make."""
    docs = tokenize.tokenize_documents(_documents(spark, sf_dir).where("text is not null"))
    return docs.select("doc_id", F.size("tokens").cast("long").alias("n"), D.doc_text(F.col("tokens")).alias("text"))


def tokenize_no_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rule families off: the same as plain segments."""
    return tokenize.tokenize(_documents(spark, sf_dir), "doc_id", rules=NO_RULES)


def tokenize_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 to T16 under rules of our own, counted by token."""
    tokens = tokenize.tokenize(_documents(spark, sf_dir), "doc_id", rules=CUSTOM)
    return tokens.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.col("space_after").cast("long")).alias("spaced"))


def split_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and characters that each split has in each file."""
    docs, metas = _table(spark, sf_dir, "text_docs"), _table(spark, sf_dir, "dataset_metas")
    parts = [split_of_table(docs, metas, s).select(F.lit(s).alias("split"), "data_path", "text") for s in SPLITS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("split", "data_path").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("characters"))


def read_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each split written to text files, and the lines read from them, counted."""
    docs, metas, folder = _table(spark, sf_dir, "text_docs").where("text is not null"), _table(spark, sf_dir, "dataset_metas"), scratch(spark)
    for s in SPLITS:
        line = F.regexp_replace(F.regexp_replace("text", r"[\r\n]+\z", ""), r"[\r\n]", " ")
        split_of_table(docs, metas, s).select(line.alias("value")).write.text(f"{folder}/{s}")
    meta = TextDatasetMeta(*(f"{folder}/{s}" for s in SPLITS))
    parts = [rows.select(F.lit(s).alias("split"), F.regexp_replace("text", r"\n\z", "").alias("line")) for s, rows in textsplits.read_dataset(spark, meta).items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("split", "line").agg(F.count("*").alias("n"))


def encoded_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary made of the training records alone, grown by the valid and then the test records, and all of them encoded."""
    docs, metas = _table(spark, sf_dir, "text_docs").where("text is not null"), _table(spark, sf_dir, "dataset_metas")
    splits = {s: split_of_table(docs, metas, s).groupBy("td_id").agg(F.min("text").alias("text")) for s in SPLITS}
    found = textsplits.encoded_splits(splits, vocab.SentenceEncoder(lambda df: segment_rows(df, "td_id", "text")), "td_id")
    parts = [df.select(F.lit(s).alias("split"), "td_id", "position", "token_id") for s, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document that has some, as one array of strings."""
    return _documents(spark, sf_dir).where("text <> ''").select("doc_id", segment_texts(F.col("text")).alias("tokens"))


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.build_vocab_of_arrays(_token_arrays(spark, sf_dir), "doc_id")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _token_arrays(spark, sf_dir)
    return vocab.encode_arrays(docs, _vocab(spark, sf_dir))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.stream_of_documents(_encoded(spark, sf_dir), ["doc_id"])


def _id_rows(encoded: DataFrame) -> DataFrame:
    rows = encoded.select("doc_id", F.posexplode("ids").alias("position", "token_id"))
    return rows.withColumn("position", F.col("position").cast("long"))


def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all tokens of the documents in order of first occurrence."""
    return _vocab(spark, sf_dir).select("token", "id")


def vocab_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of the English documents, grown by all documents."""
    english = _documents(spark, sf_dir).where("lang = 'en'")
    known = vocab.build_vocab(segment_rows(english, "doc_id", "text"), ["doc_id", "position"])
    return vocab.extend_vocab(known, _segments(spark, sf_dir), ["doc_id", "position"]).select("token", "id")


def encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: the id of every token of every document."""
    return _id_rows(_encoded(spark, sf_dir))


def encode_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 with the rule-based tokens; the tokens are written once, as the vocabulary is made of them too."""
    docs = cut_table(tokenize.tokenize_documents(_documents(spark, sf_dir)).select("doc_id", F.col("tokens.text").alias("tokens")))
    return _id_rows(vocab.encode_arrays(docs, vocab.build_vocab_of_arrays(docs, "doc_id")))


def encode_saved_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5 with a saved vocabulary that doesn't grow: how many stored tokens have which id (null: not in it)."""
    encoded = vocab.encode(_table(spark, sf_dir, "tokens").select("text"), _table(spark, sf_dir, "vocab"))
    return encoded.groupBy("token_id").agg(F.count("*").alias("n"))


def decode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the stored token stream, counted; ids that came after the vocabulary was saved have none."""
    found = vocab.decode(_table(spark, sf_dir, "token_stream"), _table(spark, sf_dir, "vocab"))
    return found.groupBy("token").agg(F.count("*").alias("n"))


def stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded data set: all documents one after the other."""
    return lm.stream_rows(_stream(spark, sf_dir))


def lm_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, examples and batches."""
    return lm.sizes(_stream(spark, sf_dir), BPTT_LEN, BATCH_SIZE)


def lm_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input and target of every place of every example."""
    return lm.example_rows(lm.examples(_stream(spark, sf_dir), BPTT_LEN))


def lm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole batches, time first."""
    return lm.batches(_stream(spark, sf_dir), BPTT_LEN, BATCH_SIZE)


def lm_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B2: the matrices that the iterator gives, each as one string, row after row."""
    made = lm.matrices(_stream(spark, sf_dir), BPTT_LEN, BATCH_SIZE)
    return made.select("batch_id", *(F.array_join(F.flatten(c), " ").alias(c) for c in ("input", "target")))


def windowed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts by time window of the streaming operators, over a table."""
    docs = _table(spark, sf_dir, "documents").select(F.col("collected_at").cast("timestamp").alias("at"), "text")
    counts = windowed_counts(docs, "at", window="1 day")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "token", "n")


def doc_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes set on documents, set anew, and read; one that isn't set is null."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("source"), F.array("source"), F.lit("state"), F.array(F.lit("new"))).alias("a"))
    a = D.set_attribute(D.set_attribute(F.col("a"), "state", ["read", "kept"]), "topic", ["text"])
    read = lambda n: F.array_join(D.attribute(a, n), ",")
    return docs.select("doc_id", F.get(D.attribute(a, "source"), F.lit(0)).alias("source"), read("state").alias("state"), read("topic").alias("topic"), read("other").alias("other"))


def sql_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 to L21 by their SQL functions: flag word and shape of every distinct token."""
    L.register_sql(spark, STOPS)
    return _words(spark, sf_dir).select("word", F.expr("flag_word(word)").alias("flags"), F.expr("word_shape(word)").alias("shape"))


def lexeme_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the derived strings of every entry of the saved vocabulary."""
    saved = _table(spark, sf_dir, "vocab")
    rows = lexeme.lexemes(saved, stops=STOPS)
    return lexeme.lexeme_ids(rows, lexeme.string_store(saved, rows))


def embedding_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the lexemes whose id has one, and their norms."""
    rows = lexeme.with_vectors(lexeme.lexemes(_table(spark, sf_dir, "vocab")), _table(spark, sf_dir, "embeddings"))
    return rows.select("id", "orth", "has_vector", F.round("vector_norm", 4).alias("norm"))


QUERIES = (
    tokenize_default, split_tokens_by_lang, segment_tokens, whitespace_tokens, doc_text_roundtrip, doc_lengths, token_at, span_slice, token_forms, lex_flags, lex_flag_names, lex_shape, lex_forms,
    like_url_email_num, stopword_filter, oov_filter, exceptions_expand, exception_table, tokenize_keep, tokenize_arrays, tokenize_no_rules, tokenize_custom_rules, split_scan, read_split, encoded_splits, vocab_first_seen, vocab_extended,
    encode_documents, encode_tokenized, encode_saved_vocab, decode_stream, stream_positions, lm_sizes, lm_examples, lm_batches, lm_matrices, windowed_tokens, doc_attributes, sql_attributes, lexeme_ids, embedding_norm,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def oracle_sql() -> dict[str, str]:
    blank, closed = f"regexp_matches(part, '^[{SPACE}]')", f"regexp_matches(part, '[{SPACE}]$')"
    segments = f"""
    parts AS (SELECT doc_id, lang, regexp_extract_all(text, '{SEGMENT}', 1) AS p FROM documents WHERE text IS NOT NULL),
    rows AS (SELECT doc_id, lang, unnest(p) AS part, unnest(range(len(p))) AS position, len(p) AS n FROM parts),
    seg AS (SELECT doc_id, lang, position,
              CASE WHEN {blank} OR NOT {closed} THEN part ELSE left(part, length(part) - 1) END AS text,
              CASE WHEN {blank} THEN position = n - 1 ELSE {closed} END AS space_after FROM rows)"""
    docs = """, doc AS (SELECT doc_id, list(struct_pack(text := text, space_after := space_after) ORDER BY position) AS t FROM seg GROUP BY doc_id)"""
    text_of = lambda x: f"list_aggregate(list_transform({x}, lambda e: e.text || CASE WHEN e.space_after THEN ' ' ELSE '' END), 'string_agg', '')"
    words = "words AS (SELECT DISTINCT word FROM (SELECT text AS word FROM tokens UNION ALL SELECT token FROM vocab) WHERE word IS NOT NULL)"
    # Letters that are small or capital without being of category Ll or Lu.
    low, up = r"\p{Ll}\x{AA}\x{BA}\x{2B0}-\x{2B8}\x{2C0}\x{2C1}\x{2E0}-\x{2E4}\x{2071}\x{207F}\x{2090}-\x{209C}\x{2170}-\x{217F}\x{24D0}-\x{24E9}", r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}"
    digit, cased = rf"[\p{{Nd}}{ODD_DIGITS}]", rf"{low}{up}\p{{Lt}}"
    is_ = lambda p: f"regexp_matches(word, '{p}')"
    tld = "split_part(regexp_extract(word, '([^.]*)$', 1), ':', 1)"
    url = f"""CASE WHEN starts_with(word, 'http://') OR starts_with(word, 'https://') OR (starts_with(word, 'www.') AND length(word) >= 5) THEN true
        WHEN starts_with(word, '.') OR ends_with(word, '.') OR contains(word, '@') OR NOT contains(word, '.') THEN false
        ELSE ends_with({tld}, '/') OR {tld} IN ({_quoted(L.TOP_LEVEL_DOMAINS)}) END"""
    bare = "replace(replace(regexp_replace(word, '^[+\\-±~]', ''), ',', ''), '.', '')"
    num = f"regexp_matches({bare}, '^(?:{digit}+|{digit}+/{digit}+)$')"
    email = is_(L.PATTERNS["like_email"].replace(r"\A", "^"))
    flags = {
        "IS_ALPHA": is_(r"^\p{L}+$"), "IS_ASCII": is_(r"^[\x00-\x7F]*$"), "IS_DIGIT": is_(f"^{digit}+$"), "IS_LOWER": f"{is_(f'[{low}]')} AND NOT {is_(rf'[{up}\p{{Lt}}]')}", "IS_PUNCT": is_(r"^\p{P}*$"),
        "IS_SPACE": is_(f"^[{SPACE}]+$"), "IS_TITLE": f"{is_(rf'[{up}\p{{Lt}}]')} AND NOT {is_(rf'[{cased}][{up}\p{{Lt}}]')} AND NOT {is_(f'(^|[^{cased}])[{low}]')}", "IS_UPPER": f"{is_(f'[{up}]')} AND NOT {is_(rf'[{low}\p{{Lt}}]')}",
        "LIKE_URL": url, "LIKE_NUM": num, "LIKE_EMAIL": email, "IS_STOP": f"lower(word) IN ({_quoted(STOPS)})", "IS_OOV": "true", "IS_BRACKET": f"word IN ({_quoted(L.BRACKETS)})",
        "IS_QUOTE": f"word IN ({_quoted(L.QUOTES)})", "IS_LEFT_PUNCT": f"word IN ({_quoted(L.LEFT_PUNCT)})", "IS_RIGHT_PUNCT": f"word IN ({_quoted(L.RIGHT_PUNCT)})", "IS_CURRENCY": is_(r"^\p{Sc}*$"),
    }
    bits = lambda without=(): " + ".join(f"CASE WHEN {c} THEN {1 << int(L.Attribute[n])} ELSE 0 END" for n, c in flags.items() if n not in without)
    coded = lambda x: rf"regexp_replace(regexp_replace(regexp_replace({x}, '\p{{Lu}}', 'X', 'g'), '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]', 'x', 'g'), '{digit}', 'd', 'g')"
    shape = f"""
    coded AS (SELECT word, {coded('word')} AS s FROM words WHERE length(word) < 100),
    chars AS (SELECT word, unnest(range(1, length(s) + 1)) AS i, s FROM coded),
    one AS (SELECT word, i, s[i:i] AS c, lag(s[i:i]) OVER w AS before FROM chars WINDOW w AS (PARTITION BY word ORDER BY i)),
    runs AS (SELECT word, i, c, sum(CASE WHEN c = before THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY i) AS run FROM one),
    placed AS (SELECT word, i, c, row_number() OVER (PARTITION BY word, run ORDER BY i) AS k FROM runs),
    shaped AS (SELECT word, string_agg(c, '' ORDER BY i) AS shape FROM placed WHERE k <= 4 GROUP BY word
               UNION ALL SELECT word, 'LONG' FROM words WHERE length(word) >= 100 UNION ALL SELECT word, '' FROM words WHERE word = '')"""
    voc = lambda src="seg": f"SELECT text AS token, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, p := position))) - 1 AS id FROM {src} GROUP BY text"
    stream = f""", voc AS ({voc()}), stream AS (SELECT row_number() OVER (ORDER BY doc_id, position) - 1 AS pos, id AS token_id FROM seg JOIN voc ON seg.text = voc.token)"""
    pairs = f""", pairs AS (SELECT pos // {BPTT_LEN} AS example_id, pos % {BPTT_LEN} AS t, token_id AS input_id, lead(token_id) OVER (ORDER BY pos) AS target_id FROM stream),
    sizes AS (SELECT count(*) AS n, greatest(count(*) - 1, 0) // {BPTT_LEN} AS e, greatest(count(*) - 1, 0) // {BPTT_LEN} // {BATCH_SIZE} AS b FROM stream)"""
    known = "row_number() OVER (ORDER BY min(struct_pack(d := td_id, p := position))) - 1"
    encoded = f"""
    WITH docs AS (SELECT split, td_id AS doc_id, '' AS lang, min(text) AS text FROM (SELECT s.split, t.td_id, t.text FROM text_docs t JOIN (
            {' UNION '.join(f"SELECT '{s}' AS split, {s}_path AS data_path FROM dataset_metas WHERE {s}_path IS NOT NULL" for s in SPLITS)}) s USING (data_path) WHERE t.text IS NOT NULL) GROUP BY split, td_id),
    parts AS (SELECT split, doc_id, regexp_extract_all(text, '{SEGMENT}', 1) AS p FROM docs),
    rows AS (SELECT split, doc_id AS td_id, unnest(p) AS part, unnest(range(len(p))) AS position FROM parts),
    seg AS (SELECT split, td_id, position, CASE WHEN {blank} OR NOT {closed} THEN part ELSE left(part, length(part) - 1) END AS text FROM rows),
    a AS (SELECT text, {known} AS id FROM seg WHERE split = 'train' GROUP BY text),
    b AS (SELECT text, {known} + (SELECT count(*) FROM a) AS id FROM seg WHERE split = 'valid' AND text NOT IN (SELECT text FROM a) GROUP BY text),
    ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    c AS (SELECT text, {known} + (SELECT count(*) FROM ab) AS id FROM seg WHERE split = 'test' AND text NOT IN (SELECT text FROM ab) GROUP BY text)
    SELECT split, td_id, position, id AS token_id FROM seg JOIN (SELECT * FROM ab UNION ALL SELECT * FROM c) v ON seg.text = v.text"""
    rules = "(SELECT surface, piece_no, arg_min(orth, exc_id) AS orth FROM token_exceptions GROUP BY surface, piece_no)"
    split = " UNION ALL ".join(f"SELECT '{s}' AS split, data_path, text FROM text_docs WHERE data_path IN (SELECT {s}_path FROM dataset_metas WHERE {s}_path IS NOT NULL)" for s in SPLITS)
    heads, tails = r"""[("<\-]""", r"[)>,.:;!?]"
    lower_of = r"regexp_replace(lower(word), '(\p{L})σ($|[^\p{L}])', '\1ς\2', 'g')"
    exceptions = ", ".join(f"({_quoted([k])}, {i}, {_quoted([p])}, {_quoted([norm_of(p)])})" for k, v in DEFAULT.table.items() for i, p in enumerate(v))
    lex = lambda c: f"SELECT id AS rank, {c}"
    return {
        "split_tokens_by_lang": "SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL) GROUP BY lang, token",
        "tokenize_default": f"WITH RECURSIVE {token_ctes(segments)} SELECT doc_id, position, text, space_after FROM tok",
        "tokenize_keep": f"WITH RECURSIVE {token_ctes(segments, keep=True)} SELECT doc_id, position, text, space_after FROM tok",
        "tokenize_arrays": f"""WITH RECURSIVE {token_ctes(segments)}, made AS (SELECT doc_id, count(*) AS n, string_agg(text || CASE WHEN space_after THEN ' ' ELSE '' END, '' ORDER BY position) AS text FROM tok GROUP BY doc_id)
            SELECT doc_id, coalesce(n, 0) AS n, coalesce(made.text, '') AS text FROM documents LEFT JOIN made USING (doc_id) WHERE documents.text IS NOT NULL""",
        "exception_table": f"""WITH known(surface, piece_no, orth, norm) AS (VALUES {exceptions}), counts AS (SELECT text, count(*) AS n FROM tokens GROUP BY text)
            SELECT surface, piece_no, orth, norm, coalesce(n, 0) AS n FROM known LEFT JOIN counts ON surface = text""",
        "segment_tokens": f"WITH {segments} SELECT doc_id, position, text, space_after FROM seg",
        "tokenize_no_rules": f"WITH {segments} SELECT doc_id, position, text, space_after FROM seg",
        "whitespace_tokens": f"WITH {segments} SELECT doc_id, count(*) AS n, sum(length(text)) AS characters, max(space_after) AS at_end FROM seg WHERE regexp_matches(text, '^[{SPACE}]+$') GROUP BY doc_id",
        "doc_text_roundtrip": f"WITH {segments} SELECT doc_id, string_agg(text || CASE WHEN space_after THEN ' ' ELSE '' END, '' ORDER BY position) AS text FROM seg GROUP BY doc_id",
        "doc_lengths": f"WITH {segments} SELECT doc_id, count(*) AS tokens, sum(length(text) + CASE WHEN space_after THEN 1 ELSE 0 END) AS characters FROM seg GROUP BY doc_id",
        "token_at": f"WITH {segments}{docs} SELECT doc_id, t[1].text AS first, t[10].text AS tenth, t[-1].text AS last, t[-3].text AS third_last FROM doc",
        "span_slice": f"""WITH {segments}{docs}, bounds AS (SELECT doc_id, t, len(t) AS n, least(len(t), 8) AS high, greatest(least(len(t), 20) - 4, least(len(t), 3)) AS low FROM doc)
            SELECT doc_id, coalesce({text_of('t[3:7]')}, '') AS from_two,
                   coalesce({text_of('list_slice(t, greatest(n - 5, 0) + 1, greatest(n - 1, 0))')}, '') AS near_end,
                   coalesce({text_of('list_slice(t, low + 1, least(n, 20))')}, '') AS inner, CASE WHEN high > 0 THEN t[high].text END AS span_last FROM bounds""",
        "token_forms": "SELECT td_id, token_position, text || CASE WHEN coalesce(space_after, false) THEN ' ' ELSE '' END AS with_ws, 'Token[' || text || ']' AS printed FROM tokens WHERE text IS NOT NULL",
        "lex_flags": f"WITH {words} SELECT word, CAST({bits()} AS BIGINT) AS flags FROM words",
        "lex_flag_names": f"WITH {words} SELECT word, {', '.join(f'({c}) AS {n.lower()}' for n, c in flags.items())}, CAST({bits(('IS_OOV',))} AS BIGINT) AS without_oov FROM words",
        "lex_shape": f"WITH {words}, {shape} SELECT word, shape FROM shaped",
        "lex_forms": f"WITH {words} SELECT word, {lower_of} AS lower, left(word, 1) AS prefix, right(word, 3) AS suffix, length(word) AS length FROM words",
        "like_url_email_num": f"WITH {segments}, words AS (SELECT DISTINCT text AS word FROM seg WHERE NOT regexp_matches(text, '^[{SPACE}]+$')) SELECT word, {url} AS url, {email} AS email, {num} AS num FROM words",
        "stopword_filter": f"SELECT data_path, count(*) AS n FROM tokens WHERE text IS NOT NULL AND lower(text) NOT IN ({_quoted(STOPS)}) GROUP BY data_path",
        "oov_filter": "SELECT text, count(*) AS n FROM tokens WHERE text IS NOT NULL AND text NOT IN (SELECT token FROM vocab WHERE token IS NOT NULL) GROUP BY text",
        "exceptions_expand": f"SELECT surface, piece_no, orth, count(DISTINCT (td_id, token_position)) AS n FROM tokens JOIN {rules} r ON tokens.text = r.surface GROUP BY surface, piece_no, orth",
        "tokenize_custom_rules": rf"""WITH {segments},
            cut AS (SELECT text, space_after, regexp_extract(text, '^({heads}*)', 1) AS head FROM seg WHERE NOT regexp_matches(text, '^[{SPACE}]')),
            cut2 AS (SELECT head, space_after, text[length(head) + 1:] AS rest, regexp_extract(text[length(head) + 1:], '({tails}*)$', 1) AS tail FROM cut),
            cut3 AS (SELECT space_after, string_split(head, '') AS head, string_split(tail, '') AS tail, left(rest, length(rest) - length(tail)) AS mid FROM cut2),
            whole AS (SELECT space_after, list_filter(head, lambda x: x <> '') || regexp_extract_all(mid, '~|[^~]+') || list_filter(tail, lambda x: x <> '') AS p FROM cut3 WHERE NOT regexp_matches(mid, '^~|~~|~$')),
            long AS (SELECT unnest(p) AS text, unnest(range(1, len(p) + 1)) = len(p) AND space_after AS space_after FROM whole
                     UNION ALL SELECT text, space_after FROM seg WHERE regexp_matches(text, '^[{SPACE}]'))
            SELECT text, count(*) AS n, sum(CASE WHEN space_after THEN 1 ELSE 0 END) AS spaced FROM long GROUP BY text""",
        "split_scan": f"SELECT split, data_path, count(*) AS lines, sum(length(text)) AS characters FROM ({split}) GROUP BY split, data_path",
        "read_split": f"SELECT split, regexp_replace(regexp_replace(text, '[\\r\\n]+$', ''), '[\\r\\n]', ' ', 'g') AS line, count(*) AS n FROM ({split}) WHERE text IS NOT NULL GROUP BY ALL",
        "encoded_splits": encoded,
        "lm_matrices": f"""WITH {segments}{stream}{pairs}, m AS (SELECT example_id // {BATCH_SIZE} AS batch_id, t, example_id % {BATCH_SIZE} AS col, input_id, target_id FROM pairs WHERE example_id // {BATCH_SIZE} < (SELECT b FROM sizes))
            SELECT batch_id, string_agg(input_id, ' ' ORDER BY t, col) AS input, string_agg(target_id, ' ' ORDER BY t, col) AS target FROM m GROUP BY batch_id""",
        "windowed_tokens": f"""WITH RECURSIVE {token_ctes(segments)} SELECT strftime(date_trunc('day', collected_at), '%Y-%m-%d') AS day, tok.text AS token, count(*) AS n
            FROM tok JOIN documents USING (doc_id) WHERE collected_at IS NOT NULL GROUP BY ALL""",
        "doc_attributes": "SELECT doc_id, source, 'read,kept' AS state, 'text' AS topic, CAST(NULL AS VARCHAR) AS other FROM documents",
        "sql_attributes": f"WITH {words}, {shape} SELECT words.word, CAST({bits().replace('word', 'words.word')} AS BIGINT) AS flags, shape FROM words JOIN shaped ON words.word = shaped.word",
        "vocab_first_seen": f"WITH {segments} {voc()}",
        "vocab_extended": f"""WITH {segments}, en AS (SELECT * FROM seg WHERE lang = 'en'), known AS ({voc('en')}), new AS (SELECT * FROM seg WHERE text NOT IN (SELECT token FROM known)), more AS ({voc('new')})
            SELECT token, id FROM known UNION ALL SELECT token, id + (SELECT count(*) FROM known) FROM more""",
        "encode_documents": f"WITH {segments}, voc AS ({voc()}) SELECT doc_id, position, id AS token_id FROM seg JOIN voc ON seg.text = voc.token",
        "encode_tokenized": f"WITH RECURSIVE {token_ctes(segments)}, voc AS ({voc('tok')}) SELECT doc_id, position, id AS token_id FROM tok JOIN voc ON tok.text = voc.token",
        "encode_saved_vocab": "SELECT id AS token_id, count(*) AS n FROM tokens LEFT JOIN vocab ON tokens.text = vocab.token GROUP BY id",
        "decode_stream": "SELECT token, count(*) AS n FROM token_stream LEFT JOIN vocab ON token_stream.token_id = vocab.id GROUP BY token",
        "stream_positions": f"WITH {segments}{stream} SELECT pos, token_id FROM stream",
        "lm_sizes": f"WITH {segments}{stream}{pairs} SELECT n AS n_tokens, e AS num_examples, b AS num_batches FROM sizes",
        "lm_examples": f"WITH {segments}{stream}{pairs} SELECT example_id, t, input_id, target_id FROM pairs WHERE example_id < (SELECT e FROM sizes)",
        "lm_batches": f"WITH {segments}{stream}{pairs} SELECT example_id // {BATCH_SIZE} AS batch_id, t, example_id % {BATCH_SIZE} AS col, input_id, target_id FROM pairs WHERE example_id // {BATCH_SIZE} < (SELECT b FROM sizes)",
        "lexeme_ids": f"""WITH words AS (SELECT token AS word, id FROM vocab), {shape.replace('SELECT word, ', 'SELECT word, ')},
            lexs AS (SELECT v.id, word, {lower_of} AS lower, s.shape, left(word, 1) AS prefix, right(word, 3) AS suffix, 'en' AS lang, length(word) AS length, CAST({bits()} AS BIGINT) AS flags
                    FROM words v JOIN shaped s USING (word)),
            strings AS (SELECT DISTINCT unnest([lower, shape, prefix, suffix, lang]) AS token FROM lexs),
            fresh AS (SELECT token, (SELECT max(id) + 1 FROM vocab) + row_number() OVER (ORDER BY token COLLATE "C") - 1 AS id FROM strings WHERE token NOT IN (SELECT token FROM vocab)),
            store AS (SELECT token, id FROM vocab UNION ALL SELECT token, id FROM fresh)
            {lex('a.id AS lower, b.id AS shape, c.id AS prefix, d.id AS suffix, e.id AS lang, length, flags').replace('id AS rank', 'l.id AS rank')}
            FROM lexs l JOIN store a ON l.lower = a.token JOIN store b ON l.shape = b.token JOIN store c ON l.prefix = c.token JOIN store d ON l.suffix = d.token JOIN store e ON l.lang = e.token""",
        "embedding_norm": """SELECT v.id, v.token AS orth, e.embedding IS NOT NULL AS has_vector,
            round(sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM vocab v LEFT JOIN embeddings e ON v.id = e.vec_id""",
    }
