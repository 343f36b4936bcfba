"""The default word splitter as SQL: a recursive query that peels one affix a step, without look-around."""

from __future__ import annotations

from lexiflow.functions.chars import SPACE
from lexiflow.operators.rules import DEFAULT, UNITS

#: Parts the pieces of a word; a private character that no text has.
BORDER = "\uE000"


# The signs of the rules, written down again as classes; units and exceptions are the only tables shared with the rules.
MARK, QUOTE = r"…,:;!?¿؟¡()\[\]{}<>_#*&。？！，、；：～·।،۔؛٪", r"'\"”“`‘´’‚,„»«「」『』（）〔〕【】《》〈〉"
MONEY, DOTS, DASH = r"(?:US|C|A)?\$|[£€¥฿₽﷼₴]", r"\.\.+|…", r"-{1,3}|–|——?|~"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def token_ctes(segments: str, keep: bool = False) -> str:
    """Common tables up to ``tok`` (doc_id, position, text, space_after), after ``seg`` of ``segments``."""
    # Symbols by their Unicode category, not by the table under test; the driver's tables have none that only one of them knows.
    symbol = r"\p{So}"
    # Letters by their Unicode properties: small or capital ones, both with the scripts that have no case.
    uncased = "".join(rf"\p{{{x}}}" for x in ("Bengali", "Hebrew", "Arabic", "Sinhala", "Devanagari", "Kannada", "Tamil", "Telugu", "Hangul", "Han"))
    alpha, lower, upper = r"\p{L}" + uncased, r"\p{Ll}" + uncased, r"\p{Lu}" + uncased
    prefix = f"{DOTS}|{MONEY}|[§%=—–{MARK}{QUOTE}]|{symbol}"
    suffix = f"{DOTS}|['’][sS]|[—–{MARK}{QUOTE}]|{symbol}"
    after = [
        r"[0-9](\+)$", r"°[FfCcKk](\.)$", f"[0-9]({MONEY})$", f"[0-9]({'|'.join(UNITS)})$", rf"[0-9{lower}%²\-+|{MARK}{QUOTE}](\.)$", rf"[{upper}][{upper}](\.)$",
    ]
    longest = ", ".join([f"length(regexp_extract(rest, {_literal(f'(?:{suffix})$')}))", *(f"length(regexp_extract(rest, {_literal(p)}, 1))" for p in after)])
    inner = "rest"
    for pattern, times in (
        (rf"()({DOTS}|{symbol})()", 1), (r"([0-9])([+\-*^])([0-9-])", 2), (rf"([{lower}{QUOTE}])(\.)([{upper}{QUOTE}])", 2), (f"([{alpha}])(,)([{alpha}])", 2),
        (f"([{alpha}])({DASH})([{alpha}])", 2), (f"([{alpha}0-9])([:<>=/])([{alpha}])", 2),
    ):
        for _ in range(times):
            inner = f"regexp_replace({inner}, {_literal(pattern)}, {_literal(rf'\1{BORDER}\2{BORDER}\3')}, 'g')"
    cut = "s" if keep else rf"CASE WHEN starts_with(s, '{BORDER}') THEN '' ELSE regexp_replace(s, '{BORDER}{BORDER}[\s\S]*$', '') END"
    known = ", ".join(f"({_literal(k)}, [{', '.join(map(_literal, v))}])" for k, v in DEFAULT.table.items())
    blank = f"regexp_matches(text, '^[{SPACE}]')"
    return f"""{segments},
    exc(surface, pieces) AS (VALUES {known}),
    peel AS (
        SELECT DISTINCT text AS word, text AS rest, []::VARCHAR[] AS head, []::VARCHAR[] AS tail, 0 AS misses, true AS front, NULL::VARCHAR[] AS found FROM seg WHERE NOT {blank}
        UNION ALL
        SELECT word, CASE WHEN pieces IS NOT NULL THEN '' WHEN front THEN rest[n + 1:] ELSE left(rest, length(rest) - n) END,
               CASE WHEN pieces IS NULL AND front AND n > 0 THEN list_append(head, left(rest, n)) ELSE head END,
               CASE WHEN pieces IS NULL AND NOT front AND n > 0 THEN list_prepend(right(rest, n), tail) ELSE tail END,
               CASE WHEN n > 0 THEN 0 ELSE misses + 1 END, NOT front, pieces
        FROM (SELECT p.*, e.pieces,
                     CASE WHEN NOT front THEN greatest({longest})
                          WHEN starts_with(rest, '+') THEN CASE WHEN regexp_matches(rest, '^\\+[0-9]') THEN 0 ELSE 1 END
                          ELSE length(regexp_extract(rest, {_literal(f'^(?:{prefix})')})) END AS n
              FROM peel p LEFT JOIN exc e ON p.rest = e.surface WHERE misses < 2 AND found IS NULL)),
    mid AS (SELECT word, head, tail, found, {inner} AS s FROM peel WHERE misses >= 2 OR found IS NOT NULL),
    split AS (SELECT word, head || coalesce(found, list_filter(string_split({cut}, '{BORDER}'), lambda x: x <> '')) || tail AS pieces FROM mid),
    placed AS (SELECT doc_id, position AS seg_no, CASE WHEN {blank} THEN [text] ELSE pieces END AS pieces, space_after FROM seg LEFT JOIN split ON seg.text = split.word AND NOT {blank}),
    long AS (SELECT doc_id, seg_no, unnest(pieces) AS text, unnest(range(1, len(pieces) + 1)) AS k, len(pieces) AS n, space_after FROM placed),
    tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, k) - 1 AS position, text, k = n AND space_after AS space_after FROM long)""".replace("'^\\\\+[0-9]'", "'^\\+[0-9]'")
