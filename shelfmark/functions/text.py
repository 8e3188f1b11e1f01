"""Text columns: trimming, search tokens, phrases, JSON leaves and entity phrases."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Whitespace as Unicode defines it; a plain trim removes the space character only.
_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Characters between search tokens: everything but letters, numbers and private-use characters.
TOKEN_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
TOKEN_CHARACTER = r"[\p{L}\p{N}\p{Co}]"
_COMBINING = "".join(chr(c) for c in range(0x0300, 0x0370))


def _latin_folds() -> tuple[str, str]:
    """Lower-case Latin letters with exactly one diacritic, and their base letters."""
    marked, plain = [], []
    for code in range(0x00C0, 0x1F00):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]) \
                and char == char.lower():
            marked.append(char)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _latin_folds()


def strip(text: Column) -> Column:
    """Remove whitespace of any kind from both ends."""
    return F.btrim(text, F.lit(_SPACE))


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics, whether composed or combining."""
    # Characters without a counterpart in the replacement are dropped.
    return F.translate(F.lower(text), _MARKED + _COMBINING, _PLAIN)


def tokens(text: Column) -> Column:
    """Search tokens, in text order."""
    return F.array_remove(F.split(fold(text), TOKEN_BREAK), "")


NO_TOKENS = "  "   # the padded form of a text without any token


def padded(token_array: Column) -> Column:
    """Tokens joined by single spaces with a space at both ends.

    Two padded texts turn a phrase match on whole tokens into a plain ``contains``.
    """
    return F.concat(F.lit(" "), F.array_join(token_array, " "), F.lit(" "))


def padded_text(text: Column) -> Column:
    """``padded(tokens(text))`` in one pass, without an array of tokens."""
    spaced = F.regexp_replace(fold(text), TOKEN_BREAK, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def padded_tokens(body: Column) -> Column:
    """Back from a padded text to its token array."""
    return F.split(F.trim(body), " ")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The parser stops behind the first complete value, so an end mark has to be reached as well.
    """
    mark = "end-of-text"
    marked = F.concat(F.lit("["), text, F.lit(f',"{mark}"]'))
    items = F.try_variant_get(F.try_parse_json(marked), "$", "array<variant>")
    last = F.try_variant_get(F.try_element_at(items, F.lit(2)), "$", "string")
    return F.coalesce((F.size(items) == 2) & (last == mark), F.lit(False))


# --- JSON leaves ---------------------------------------------------------------------------

# A scalar token of a JSON text. The possessive loops keep long strings off the regex stack.
_JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_JSON_SCALAR = rf'{_JSON_STRING}\s*+:?|-?\d[0-9.eE+\-]*+|true|false'


def json_leaves(json_text: Column) -> Column:
    """T5: all scalar values of a JSON text at any depth, in text order, trimmed, without blanks.

    The scalars are cut out in one pass and keys are told apart by the colon behind them; one
    ``from_json`` then decodes all of them. There is no limit on depth. Text that is not valid
    JSON has no leaves. Booleans are spelled ``True`` and ``False``.
    """
    scalars = F.regexp_extract_all(json_text, F.lit(f"({_JSON_SCALAR})"), F.lit(0))
    values = F.filter(scalars, lambda s: ~s.endswith(":"))
    spelled = F.transform(values, lambda s: F.when(s == "true", F.lit('"True"'))
                          .when(s == "false", F.lit('"False"')).otherwise(s))
    decoded = F.from_json(F.concat(F.lit("["), F.array_join(spelled, ","), F.lit("]")),
                          "array<string>")
    cleaned = F.filter(F.transform(decoded, strip), lambda s: s != "")
    return F.when(is_json(json_text), cleaned).otherwise(F.array().cast("array<string>"))


# --- entities ------------------------------------------------------------------------------

# Runs of capitalised words or model codes (letters with digits), joined by single spaces.
_ENTITY_WORD = r"(?:\p{Lu}[\p{L}\p{N}&'\-]*|\p{N}+[\p{Lu}][\p{L}\p{N}\-]*)"
ENTITY_RUN = rf"{_ENTITY_WORD}(?: {_ENTITY_WORD})*"
# Counts and ordinals are no useful phrases.
ENTITY_NUMBER = r"^[0-9.,]+(?:st|nd|rd|th|ST|ND|RD|TH)?$"


def entity_phrases(text: Column) -> Column:
    """Default entity phrases of one text; the whole text where none is found.

    A rule stands in for a trained tagger: runs of capitalised words and model codes.
    """
    runs = F.regexp_extract_all(text, F.lit(f"({ENTITY_RUN})"), F.lit(0))
    kept = F.filter(runs, lambda r: ~r.rlike(ENTITY_NUMBER))
    # Through a one-element array, so that the search runs once.
    return F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k)
                       .otherwise(F.array(text)))[0]


def entity_lists(texts: Column) -> Column:
    """Entity phrases for an array of texts: ``array<string>`` to ``array<array<string>>``.

    This is the plug-in point: a pandas UDF with the same input and output type can run any
    tagger in its place.
    """
    return F.transform(texts, entity_phrases)
