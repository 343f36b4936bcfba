"""SQL of the training-data queries for DuckDB, with tables of its own: nothing here comes from the operators.

Look-alikes, copies and overlaps are told by keys that SQL can make (regular expressions, ``translate`` and
``nfc_normalize``); near overlaps by comparing all pairs, the words of a pair written as single bytes, with ``levenshtein``.
The tables cover the characters and the styles of named fields that the driver's tables hold.
"""

from __future__ import annotations

MARK = """
    CASE WHEN occurrences < 5 OR records < 3 THEN 'rare'
         WHEN records > 0.1 * (SELECT count(DISTINCT td_id) FROM seen) THEN 'common' END AS mark
"""
TERMS = """
WITH seen AS (SELECT td_id, token_position, max(text) AS token FROM tokens
              WHERE td_id IS NOT NULL AND token_position IS NOT NULL GROUP BY td_id, token_position),
     freq AS (SELECT token, count(*) AS occurrences, count(DISTINCT td_id) AS records FROM seen WHERE token IS NOT NULL GROUP BY token)
"""
IDS = """
WITH seen AS (SELECT td_id, pos, max(token_id) AS token_id FROM token_stream
              WHERE td_id IS NOT NULL AND pos IS NOT NULL GROUP BY td_id, pos),
     freq AS (SELECT token_id, count(*) AS occurrences, count(DISTINCT td_id) AS records FROM seen WHERE token_id IS NOT NULL GROUP BY token_id)
"""

# What is drawn like what, capitals and small letters; then accented letters, and small letters whose capitals are.
LIKE = ("асԁеһіјӏорԛѕԝхуАВСЕНІЈКМОРЅТХУονΑΒΕΗΙΚΜΝΟΡΤΧΥΖ", "acdehijlopqswxyABCEHIJKMOPSTXYovABEHIKMNOPTXYZ")
ACCENTED = ("ёЁїЇѐЀӑӐӓӒόΌΆΈΊΎ", "ëËïÏèÈăĂäÄóÓÁÉÍÝ")
SMALL = ("внкмтαβεηικμορτχυζ", "bhkmtabehikmoptxyz")
UNSEEN = r"[\x{AD}\x{34F}\x{61C}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0000}-\x{E0FFF}]"
BLANK = r"[\x0B\x0C\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("＇", "＇"), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
NAME, SIGNS = r"[\p{L}][\p{L}\p{N}_.-]*", r"[^\p{L}\p{N}]*"
ALNUM = r"[\p{L}\p{N}]+"


def _look(x: str) -> str:
    """The text with everything at its prototype."""
    x = f"translate(regexp_replace(regexp_replace({x}, '{UNSEEN}', '', 'g'), '{BLANK}', ' ', 'g'), '{WIDE[0]}', '{WIDE[1]}')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ſ", "s"), ("µ", "μ")):
        x = f"replace({x}, '{ligature}', '{letters}')"
    return f"nfc_normalize(translate(translate(nfc_normalize({x}), '{ACCENTED[0]}', '{ACCENTED[1]}'), '{LIKE[0]}', '{LIKE[1]}'))"


def _fold(x: str) -> str:
    return f"translate(replace(lower({_look(x)}), 'ß', 'ss'), '{SMALL[0]}', '{SMALL[1]}')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'), ' ')"


def _letters(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _runs(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{ALNUM}'))"


def _once(key: str, text: str, table: str) -> str:
    return f"SELECT {key} AS k, min({text}) AS text FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL GROUP BY {key}"


def _looks(runs: int, source: str) -> str:
    return f"""SELECT k, form, raw FROM (SELECT k, {_collapse(_look('text'))} AS form, {_collapse('text')} AS raw FROM ({source}))
        WHERE form <> '' AND {_runs('form')} >= {runs}"""


def _copies(runs: int) -> str:
    """(k, key): what the copies of a record share."""
    mark = "\x1e\\1\x1f"
    styles = (
        (f"^{SIGNS}<{NAME}>", f"<({NAME})>"),
        (rf'^{SIGNS}"{NAME}"\s*:', rf'"({NAME})"\s*:'),
        (rf"(?s)^{SIGNS}{NAME}\s*:.*\|\s*{NAME}\s*:", rf"(?:^{SIGNS}|\|\s*)({NAME})\s*:"),
        (rf"(?s)^{SIGNS}{NAME}:\S.*\s{NAME}:\S", rf"(?:^{SIGNS}|\s)({NAME}):"),
        (rf"(?s)^{SIGNS}{NAME}\s*=.*;\s*{NAME}\s*=", rf"(?:^{SIGNS}|;\s*)({NAME})\s*="),
        (rf"(?s)^{SIGNS}{NAME}\s+[-–—]\s.*,\s*{NAME}\s+[-–—]\s", rf"(?:^{SIGNS}|,\s*)({NAME})\s+[-–—]\s"),
    )
    marked = "CASE " + " ".join(f"WHEN regexp_matches(f, '{test}') THEN regexp_replace(f, '{sign}', '{mark}', 'g')" for test, sign in styles) + " END"
    part = lambda i: _letters(f"split_part(p, '\x1f', {i})")
    return f"""SELECT k, CASE WHEN len(parts) > 2 THEN array_to_string(list_sort(list_transform(parts[2:], lambda p: {part(1)} || '\x1f' || {part(2)})), '\x1e') ELSE {_letters('f')} END AS key
        FROM (SELECT k, f, string_split({marked}, '\x1e') AS parts FROM (SELECT k, {_fold('text')} AS f FROM ({_once('td_id', 'text', 'text_docs')}))) WHERE {_runs('f')} >= {runs}"""


def _overlaps() -> str:
    """Tables ``rec`` (k, side, split, id of its class) and ``near`` (a: training class, b: evaluation class, edits)."""
    paths = " UNION ".join(f"SELECT {s}_path AS data_path, '{s}' AS split FROM dataset_metas WHERE {s}_path IS NOT NULL" for s in ("train", "valid", "test"))
    words = "f"
    for a, signs in (("L", "''’ʼ‘`´"), ("L", "''’ʼ‘`´"), ("N", ".,’''"), ("N", ".,’''")):
        words = rf"regexp_replace({words}, '(\p{{{a}}})[{signs}](\p{{{a}}})', '\1\2', 'g')"
    words = rf"string_split(trim(regexp_replace({words}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    code = lambda x: f"list_aggregate(list_transform({x}, lambda w: chr(CAST(list_position(u, w) AS INTEGER))), 'string_agg', '')"
    return f"""
    paths AS ({paths}),
    folded AS (SELECT td_id AS k, split, {_fold('min(text)')} AS f FROM text_docs JOIN paths USING (data_path) WHERE td_id IS NOT NULL AND text IS NOT NULL GROUP BY td_id, split),
    rec AS (SELECT k, split, split = 'train' AS train, {_letters('f')} AS id, {words} AS w FROM folded WHERE {_runs('f')} >= 8),
    class AS (SELECT train, id, min(w) AS w, len(min(w)) AS n, list_distinct(min(w)) AS d FROM rec GROUP BY train, id),
    maybe AS (SELECT a.id AS a, b.id AS b, a.w AS wa, b.w AS wb, (greatest(a.n, b.n) - 1) // 8 AS most, list_distinct(a.w || b.w) AS u
             FROM class a JOIN class b ON a.train AND NOT b.train AND a.id <> b.id AND abs(a.n - b.n) * 8 < greatest(a.n, b.n)
             WHERE greatest(len(a.d), len(b.d)) - len(list_intersect(a.d, b.d)) <= (greatest(a.n, b.n) - 1) // 8),
    near AS (SELECT a, b, levenshtein({code('wa')}, {code('wb')}) AS edits, most FROM maybe),
    link AS (SELECT a, b, edits FROM near WHERE edits <= most UNION ALL SELECT a.id, a.id, 0 FROM class a JOIN class b ON a.id = b.id AND a.train AND NOT b.train)"""


def oracle_sql() -> dict[str, str]:
    texts = _looks(8, _once("td_id", "text", "text_docs"))
    orths = _looks(0, _once("exc_id", "orth", "token_exceptions"))
    pairs = lambda name: f"SELECT '{name}' AS field_name, a.k AS key_a, b.k AS key_b FROM {name} a JOIN {name} b ON a.form = b.form AND a.k < b.k AND a.raw <> b.raw"
    return {
        "p1_found": f"""WITH {_overlaps()} SELECT DISTINCT least(t.k, e.k) AS td_id_a, greatest(t.k, e.k) AS td_id_b
            FROM link JOIN rec t ON t.id = link.a AND t.train JOIN rec e ON e.id = link.b AND NOT e.train WHERE t.k <> e.k""",
        "p1_report": f"""WITH {_overlaps()}, n AS (SELECT id, count(DISTINCT k) AS n FROM rec WHERE train GROUP BY id),
            per AS (SELECT b AS id, sum(n) AS links, min(edits) AS edits FROM link JOIN n ON n.id = link.a GROUP BY b),
            found AS (SELECT k AS td_id, split, links, edits FROM rec JOIN per USING (id) WHERE NOT train),
            tags AS ({' UNION '.join(f"SELECT {s}_path AS data_path, '{s}' AS split, tag FROM dataset_metas WHERE {s}_path IS NOT NULL" for s in ('train', 'valid', 'test'))})
            SELECT split, tag, count(DISTINCT td_id) AS records, count(*) FILTER (edits = 0) AS exact, count(*) FILTER (edits > 0) AS near, CAST(sum(links) AS BIGINT) AS links
            FROM found JOIN (SELECT DISTINCT td_id, data_path FROM text_docs) USING (td_id) JOIN tags USING (data_path, split) GROUP BY split, tag""",
        "p3_found": f"WITH c AS ({_copies(8)}), g AS (SELECT k, min(k) OVER (PARTITION BY key) AS keep FROM c) SELECT keep AS keep_id, k AS copy_id FROM g WHERE k <> keep",
        "p3_collapsed": f"WITH c AS ({_copies(0)}) SELECT min(k) AS td_id, count(*) AS copies FROM c GROUP BY key",
        "p4_found": f"{TERMS}, m AS (SELECT token, {MARK} FROM freq) SELECT token, mark FROM m WHERE mark IS NOT NULL",
        "p4_terms": f"{TERMS} SELECT token, occurrences, records, {MARK} FROM freq",
        "p4_token_ids": f"{IDS} SELECT token_id, occurrences, records, {MARK} FROM freq",
        "p5_found": f"WITH text AS ({texts}), orth AS ({orths}) {pairs('text')} UNION ALL {pairs('orth')}",
        "p5_classes": f"""WITH f AS ({texts}), s AS (SELECT form, raw, count(*) AS n FROM f GROUP BY form, raw),
            c AS (SELECT form, min(k) AS class_id, count(*) AS rows, count(DISTINCT raw) AS spellings FROM f GROUP BY form HAVING count(DISTINCT raw) > 1)
            SELECT k AS td_id, class_id, rows, spellings, rows - n AS links FROM f JOIN c USING (form) JOIN s USING (form, raw)""",
    }
