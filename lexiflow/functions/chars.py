"""Character sets. Ranges are fixed values; letters within them are told apart by their Unicode properties."""

from __future__ import annotations

from functools import lru_cache

# White space, as str.isspace has it.
SPACE_RANGES = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

# Digits that aren't decimal (superscripts, circled and the like), as str.isdigit has them.
ODD_DIGIT_RANGES = (
    (0xB2, 0xB3), (0xB9, 0xB9), (0x1369, 0x1371), (0x19DA, 0x19DA), (0x2070, 0x2070), (0x2074, 0x2079), (0x2080, 0x2089), (0x2460, 0x2468), (0x2474, 0x247C), (0x2488, 0x2490),
    (0x24EA, 0x24EA), (0x24F5, 0x24FD), (0x24FF, 0x24FF), (0x2776, 0x277E), (0x2780, 0x2788), (0x278A, 0x2792), (0x10A40, 0x10A43), (0x10E60, 0x10E68), (0x11052, 0x1105A), (0x1F100, 0x1F10A),
)

# Blocks whose cased letters the tokenizer's letter classes hold (Latin, Greek, Cyrillic).
LATIN_RANGES = (
    (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x180, 0x1BF), (0x1C4, 0x24F), (0x250, 0x2AF), (0x1D00, 0x1D25), (0x1D6B, 0x1D77), (0x1D79, 0x1D9A),
    (0x1E00, 0x1EFF), (0x2C60, 0x2C7B), (0x2C7E, 0x2C7F), (0xA722, 0xA76F), (0xA771, 0xA787), (0xA78B, 0xA78E), (0xA790, 0xA7B9), (0xA7FA, 0xA7FA), (0xAB30, 0xAB5A), (0xAB60, 0xAB64), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A),
)
OTHER_CASED = "ёа-яЁА-Я әөүҗңһӘӨҮҖҢҺ α-ωάέίόώήύΑ-ΩΆΈΊΌΏΉΎ а-щюяіїєґА-ЩЮЯІЇЄҐ"

# Blocks of scripts without case.
UNCASED_RANGES = (
    (0x980, 0x9FF), (0x591, 0x5F4), (0xFB1D, 0xFB4F),  # Bengali, Hebrew
    (0x620, 0x64A), (0x66E, 0x6D5), (0x6E5, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8BD), (0xFB50, 0xFBB1), (0xFBD3, 0xFD3D), (0xFD50, 0xFDC7), (0xFDF0, 0xFDFB), (0xFE70, 0xFEFC), (0x1EE00, 0x1EEBB),  # Arabic
    (0xD80, 0xDFF), (0x900, 0x97F), (0xC80, 0xCFF), (0xB80, 0xBFF), (0xC00, 0xC7F), (0xAC00, 0xD7AF), (0x1100, 0x11FF),  # Sinhala, Devanagari, Kannada, Tamil, Telugu, Hangul
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2EBEF), (0x2E80, 0x2FDF), (0x2FF0, 0x303F), (0x31C0, 0x31EF), (0x3200, 0x33FF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0x1F200, 0x1F2FF), (0x2F800, 0x2FA1F),  # Han
)

# Symbols (pictographs, dingbats, technical and letter-like signs) that the tokenizer's rules know.
SYMBOL_RANGES = (
    (0xA6, 0xA6), (0xA9, 0xA9), (0xAE, 0xAE), (0xB0, 0xB0), (0x482, 0x482), (0x58D, 0x58D), (0x58E, 0x58E), (0x60E, 0x60E), (0x60F, 0x60F), (0x6DE, 0x6DE), (0x6E9, 0x6E9), (0x6FD, 0x6FD),
    (0x6FE, 0x6FE), (0x7F6, 0x7F6), (0x9FA, 0x9FA), (0xB70, 0xB70), (0xBF3, 0xBF8), (0xBFA, 0xBFA), (0xC7F, 0xC7F), (0xD4F, 0xD4F), (0xD79, 0xD79), (0xF01, 0xF03), (0xF13, 0xF13),
    (0xF15, 0xF17), (0xF1A, 0xF1F), (0xF34, 0xF34), (0xF36, 0xF36), (0xF38, 0xF38), (0xFBE, 0xFC5), (0xFC7, 0xFCC), (0xFCE, 0xFCE), (0xFCF, 0xFCF), (0xFD5, 0xFD8), (0x109E, 0x109E),
    (0x109F, 0x109F), (0x1390, 0x1399), (0x1940, 0x1940), (0x19DE, 0x19FF), (0x1B61, 0x1B6A), (0x1B74, 0x1B7C), (0x2100, 0x2100), (0x2101, 0x2101), (0x2103, 0x2106), (0x2108, 0x2108),
    (0x2109, 0x2109), (0x2114, 0x2114), (0x2116, 0x2116), (0x2117, 0x2117), (0x211E, 0x2123), (0x2125, 0x2125), (0x2127, 0x2127), (0x2129, 0x2129), (0x212E, 0x212E), (0x213A, 0x213A),
    (0x213B, 0x213B), (0x214A, 0x214A), (0x214C, 0x214C), (0x214D, 0x214D), (0x214F, 0x214F), (0x218A, 0x218A), (0x218B, 0x218B), (0x2195, 0x2199), (0x219C, 0x219F), (0x21A1, 0x21A1),
    (0x21A2, 0x21A2), (0x21A4, 0x21A4), (0x21A5, 0x21A5), (0x21A7, 0x21AD), (0x21AF, 0x21CD), (0x21D0, 0x21D0), (0x21D1, 0x21D1), (0x21D3, 0x21D3), (0x21D5, 0x21F3), (0x2300, 0x2307),
    (0x230C, 0x231F), (0x2322, 0x2328), (0x232B, 0x237B), (0x237D, 0x239A), (0x23B4, 0x23DB), (0x23E2, 0x2426), (0x2440, 0x244A), (0x249C, 0x24E9), (0x2500, 0x25B6), (0x25B8, 0x25C0),
    (0x25C2, 0x25F7), (0x2600, 0x266E), (0x2670, 0x2767), (0x2794, 0x27BF), (0x2800, 0x28FF), (0x2B00, 0x2B2F), (0x2B45, 0x2B45), (0x2B46, 0x2B46), (0x2B4D, 0x2B73), (0x2B76, 0x2B95),
    (0x2B98, 0x2BC8), (0x2BCA, 0x2BFE), (0x2CE5, 0x2CEA), (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x2FF0, 0x2FFB), (0x3004, 0x3004), (0x3012, 0x3012), (0x3013, 0x3013),
    (0x3020, 0x3020), (0x3036, 0x3036), (0x3037, 0x3037), (0x303E, 0x303E), (0x303F, 0x303F), (0x3190, 0x3190), (0x3191, 0x3191), (0x3196, 0x319F), (0x31C0, 0x31E3), (0x3200, 0x321E),
    (0x322A, 0x3247), (0x3250, 0x3250), (0x3260, 0x327F), (0x328A, 0x32B0), (0x32C0, 0x32FE), (0x3300, 0x33FF), (0x4DC0, 0x4DFF), (0xA490, 0xA4C6), (0xA828, 0xA82B), (0xA836, 0xA836),
    (0xA837, 0xA837), (0xA839, 0xA839), (0xAA77, 0xAA79), (0xFDFD, 0xFDFD), (0xFFE4, 0xFFE4), (0xFFE8, 0xFFE8), (0xFFED, 0xFFED), (0xFFEE, 0xFFEE), (0xFFFC, 0xFFFC), (0xFFFD, 0xFFFD),
    (0x10137, 0x1013F), (0x10179, 0x10189), (0x1018C, 0x1018E), (0x10190, 0x1019B), (0x101A0, 0x101A0), (0x101D0, 0x101FC), (0x10877, 0x10877), (0x10878, 0x10878), (0x10AC8, 0x10AC8),
    (0x1173F, 0x1173F), (0x16B3C, 0x16B3F), (0x16B45, 0x16B45), (0x1BC9C, 0x1BC9C), (0x1D000, 0x1D0F5), (0x1D100, 0x1D126), (0x1D129, 0x1D164), (0x1D16A, 0x1D16C), (0x1D183, 0x1D183),
    (0x1D184, 0x1D184), (0x1D18C, 0x1D1A9), (0x1D1AE, 0x1D1E8), (0x1D200, 0x1D241), (0x1D245, 0x1D245), (0x1D300, 0x1D356), (0x1D800, 0x1D9FF), (0x1DA37, 0x1DA3A), (0x1DA6D, 0x1DA74),
    (0x1DA76, 0x1DA83), (0x1DA85, 0x1DA85), (0x1DA86, 0x1DA86), (0x1ECAC, 0x1ECAC), (0x1F000, 0x1F02B), (0x1F030, 0x1F093), (0x1F0A0, 0x1F0AE), (0x1F0B1, 0x1F0BF), (0x1F0C1, 0x1F0CF),
    (0x1F0D1, 0x1F0F5), (0x1F110, 0x1F16B), (0x1F170, 0x1F1AC), (0x1F1E6, 0x1F202), (0x1F210, 0x1F23B), (0x1F240, 0x1F248), (0x1F250, 0x1F250), (0x1F251, 0x1F251), (0x1F260, 0x1F265),
    (0x1F300, 0x1F3FA), (0x1F400, 0x1F6D4), (0x1F6E0, 0x1F6EC), (0x1F6F0, 0x1F6F9), (0x1F700, 0x1F773), (0x1F780, 0x1F7D8), (0x1F800, 0x1F80B), (0x1F810, 0x1F847), (0x1F850, 0x1F859),
    (0x1F860, 0x1F887), (0x1F890, 0x1F8AD), (0x1F900, 0x1F90B), (0x1F910, 0x1F93E), (0x1F940, 0x1F970), (0x1F973, 0x1F976), (0x1F97A, 0x1F97A), (0x1F97C, 0x1F9A2), (0x1F9B0, 0x1F9B9),
    (0x1F9C0, 0x1F9C2), (0x1F9D0, 0x1F9FF), (0x1FA60, 0x1FA6D),
)


def java_class(ranges: tuple[tuple[int, int], ...]) -> str:
    """The inside of a character class, as Java and RE2 both read it."""
    return "".join(rf"\x{{{a:X}}}" if a == b else rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


def python_class(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\U{a:08X}" if a == b else rf"\U{a:08X}-\U{b:08X}" for a, b in ranges)


def _ranges_of(chars: list[int]) -> tuple[tuple[int, int], ...]:
    out: list[list[int]] = []
    for c in sorted(set(chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return tuple((a, b) for a, b in out)


def _spelled(text: str) -> list[int]:
    """Characters of a class written with ranges."""
    out, i = [], 0
    while i < len(text):
        if text[i] == " ":
            i += 1
        elif text[i + 1 : i + 2] == "-":
            out += range(ord(text[i]), ord(text[i + 2]) + 1)
            i += 3
        else:
            out.append(ord(text[i]))
            i += 1
    return out


@lru_cache(maxsize=1)
def letter_classes() -> dict[str, str]:
    """Python class insides: ``lower``, ``upper`` (both with the scripts that have no case) and ``alpha``."""
    latin = [c for a, b in LATIN_RANGES for c in range(a, b + 1)]
    other = _spelled(OTHER_CASED)
    lower = [c for c in latin + other if chr(c).islower()]
    upper = [c for c in latin + other if chr(c).isupper()]
    uncased = python_class(UNCASED_RANGES)
    return {"lower": python_class(_ranges_of(lower)) + uncased, "upper": python_class(_ranges_of(upper)) + uncased, "alpha": python_class(_ranges_of(latin + other)) + uncased}


@lru_cache(maxsize=1)
def symbol_class() -> str:
    """Python class inside: every symbol of the rules."""
    return python_class(SYMBOL_RANGES)


SPACE = java_class(SPACE_RANGES)
ODD_DIGITS = java_class(ODD_DIGIT_RANGES)
PYTHON_SPACE = python_class(SPACE_RANGES)
