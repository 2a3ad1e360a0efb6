"""Small vocabularies for queries and tests, made by rule from a few parameters; nothing is trained."""

from __future__ import annotations

from tessera.functions.text import BYTES, UNDERLINE
from tessera.operators.subword import Bpe, Unigram, WordPiece

#: Frequent letter groups, in order of rank.
GROUPS = ("th", "he", "in", "er", "an", "on", "re", "en", "ou", "ti", "nd", "ed", "es", "at", "or", "ing", "ent", "tion", "the", "and", "ion", "que", "eau", "aux", "ment", "ier", "sch", "ung", "ich", "ble", "ha", "st", "ar", "al", "de", "la", "le")
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "äöüßéèêçñíóáú"


def merges() -> list[tuple[str, str]]:
    """Each group from its letters, left to right, as byte characters; then a space before the group."""
    out: dict[tuple[str, str], None] = {}
    for g in GROUPS:
        for i in range(1, len(g)):
            out[g[:i], g[i]] = None
    for g in GROUPS:
        out[BYTES[32], g[0]] = None
        for i in range(1, len(g)):
            out[BYTES[32] + g[:i], g[i]] = None
    return list(out)


def bpe() -> Bpe:
    pairs = merges()
    return Bpe({t: i for i, t in enumerate(dict.fromkeys([*BYTES, *(a + b for a, b in pairs)]))}, pairs)


SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")


def wordpiece() -> WordPiece:
    """Letters but q, digits, punctuation and groups; all but punctuation also as continuations. So words with q are unknown."""
    own = [*(c for c in LETTERS if c != "q"), *"0123456789", *(g for g in GROUPS if "q" not in g)]
    return WordPiece({t: i for i, t in enumerate([*SPECIAL, *own, *(f"##{x}" for x in own), *"!\"#$%&'()*+,-./:;<=>?@[]^_|~"])})


def unigram() -> Unigram:
    """Letters but x at -6, groups at -4 less an eighth for each place, the space mark alone and before groups; scores are eighths."""
    pieces = [("<unk>", 0.0), (UNDERLINE, -3.0), *((c, -6.0) for c in LETTERS if c != "x")]
    pieces += [(g, -4.0 - i / 8) for i, g in enumerate(GROUPS)]
    pieces += [(UNDERLINE + g, -5.0 - i / 8) for i, g in enumerate(GROUPS)]
    return Unigram(pieces, 0)
