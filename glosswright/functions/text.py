"""Column expressions for text: tokens, n-grams, templates, symbols, numbers and the predicates over them.

Word characters are letters, digits and the underscore of any script, spelled out, because the JVM's own classes are
ASCII only. Nothing here is a user function; everything stays inside the projection it is used in.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"[\p{L}\p{N}_]"
TOKEN = rf"\[[^\]]+\]|{W}+"
#: White space of any script: the JVM's own class is ASCII only.
S = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# ---- fixed values ---------------------------------------------------------------------------------------------------
#: Code points whose names begin with HANGUL.
HANGUL = r"[ᄀ-ᇿ〮-〯ㄱ-ㆎꥠ-ꥼ가-힣ힰ-ퟆퟋ-ퟻ]"
SYLLABLE = r"[가-힣]"
EDGE_MARKS = r"[.,:;!?\"'()]"
CONDITIONS = "if|when|whenever|unless|after|before|during|instead|until|while"
KO_CONDITIONS = r"이면|면|때|때마다|않으면|않는\s*한|후에|뒤에|전에|동안|중에|대신|까지|한다면|하면"
INJECTIONS = (
    r"ignore\s+(the\s+|all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)",
    r"disregard\s+(the\s+|all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)",
    r"forget\s+(your|all|the|previous|prior)\s+(role|instructions?|rules?|context)",
    r"you\s+are\s+now\s+a?\s*(different|new|unrestricted)",
    r"act\s+as\s+if\s+(you\s+have\s+no\s+restrictions?|you\s+are\s+not\s+bound)",
    r"(new\s+)?system\s*:\s*you",
    r"</?\s*(system|admin|root|assistant|user)\s*>",
    r"\[\s*(system|admin|root|assistant|user)\s*\]",
    r"(reveal|print|show|output|repeat)\s+(your\s+)?(system|initial|original)\s+(prompt|instructions?)",
    r"(위의?|이전|기존|지금까지)\s*(모든\s*)?(지시|명령|규칙|프롬프트)[은는를]?\s*.{0,8}(무시|잊어|버려)",
    r"규칙\s*(이|가)\s*없는\s*(AI|인공지능|모드)",
    r"개발자\s*모드",
    r"지시문?\s*무시",
)
CARD_OPEN, CARD_CLOSE = "<card-text>", "</card-text>"
CARD_OPEN_ESCAPED, CARD_CLOSE_ESCAPED = "&lt;card-text&gt;", "&lt;/card-text&gt;"
# ---- end of fixed values --------------------------------------------------------------------------------------------


def has_hangul(c: Column) -> Column:
    return c.rlike(HANGUL)


def is_translated(c: Column) -> Column:
    """A value that is there and has Hangul; never null."""
    return F.coalesce(c.rlike(HANGUL), F.lit(False))


def has_syllable(c: Column) -> Column:
    return c.rlike(SYLLABLE)


def tokens(c: Column) -> Column:
    """Lower-case words; a bracketed symbol is one token."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, n_max: int = 3) -> Column:
    """All contiguous n-grams for n = 1 .. n_max, joined by spaces, in order of n and place."""

    def of(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    # the one-element array binds the words, which a lambda would else compute anew for every place
    return F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.array(*[of(w, n) for n in range(1, n_max + 1)]))))


def strip_tags(c: Column) -> Column:
    """Element tags become a space, so that the words around them stay apart."""
    return F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", " ")


def source_ngrams(c: Column, n_max: int = 3) -> Column:
    return ngrams(tokens(strip_tags(c)), n_max)


def target_tokens(c: Column, normalise=None) -> Column:
    """Space-separated words without markup and edge punctuation; `normalise` is applied to each (a lemmatiser)."""
    trimmed = lambda w: F.regexp_replace(w, rf"^{EDGE_MARKS}+|{EDGE_MARKS}+$", "")
    words = F.transform(F.split(F.regexp_replace(c, r"<[^>]*>", ""), f"{S}+"), trimmed)
    if normalise is not None:
        words = F.transform(words, normalise)
    return F.filter(words, lambda w: w != "")


def target_ngrams(c: Column, n_max: int = 3, normalise=None) -> Column:
    return ngrams(target_tokens(c, normalise), n_max)


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, rf"\A{S}+|{S}+\z", "")


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{S}+", " "), r"\A | \z", "")


def template(c: Column) -> Column:
    """A sentence with its numbers as {N} and its symbols as {SYM}."""
    out = F.regexp_replace(c, r"</?(?:strong|em|ul|li|trace)>", "")
    out = F.regexp_replace(out, r"\[[a-z0-9\-]+\]", "{SYM}")
    return squeeze(F.regexp_replace(out, "[0-9]+", "{N}"))


def sentences(c: Column) -> Column:
    parts = F.split(c, rf"\n+|(?<=[.!?]){S}+")
    return F.filter(F.transform(parts, stripped), lambda s: s != "")


def quoted(term: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def runs(c: Column) -> Column:
    """Distinct word runs, and other characters one by one, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(rf"(?s){W}+|{W.replace('[', '[^', 1)}"), F.lit(0)))


def anchors(term: Column) -> Column:
    """What every text that holds the term as a whole phrase has among its runs: the term's word runs or, of a term
    without any, its first character."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(term), F.lit(f"{W}+"), F.lit(0)))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.substring(F.lower(term), 1, 1)))


def has_phrase(text: Column, term: Column) -> Column:
    """The term as a whole phrase, whatever the case."""
    return F.regexp_like(text, F.concat(F.lit(rf"(?iu)(?<!{W})"), quoted(term), F.lit(rf"(?!{W})")))


def tight_parens(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, rf"{S}*\({S}*", "("), F.lit(" )"), F.lit(")"))


def numbers(c: Column) -> Column:
    """Digit runs without leading zeros, as strings: integers have no largest value here."""
    found = F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))


def guard_symbols(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"\[{W}(?:{W}|-)*\]"), F.lit(0))


def condition_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?i)(?<!{W})(?:{CONDITIONS})(?!{W})"))


def has_target_condition(c: Column) -> Column:
    return c.rlike(KO_CONDITIONS.replace(r"\s", S))


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, r"</?(?:strong|em|ul|li)>", "")


def source_symbols(c: Column) -> Column:
    """Symbols of a source text, traces first: Trace[3] is trace_3, [Credit] is credit."""
    trace = rf"(?i)(?<!{W})trace\[({W}+)\]"
    traces = F.transform(F.regexp_extract_all(_plain(c), F.lit(trace), F.lit(1)), lambda x: F.concat(F.lit("trace_"), F.upper(x)))
    rest = F.regexp_replace(_plain(c), trace, "")
    return F.concat(traces, F.transform(F.regexp_extract_all(rest, F.lit(r"(?i)\[([a-z][a-z0-9-]*)\]"), F.lit(1)), F.lower))


def target_symbols(c: Column) -> Column:
    """Symbols of a target text, where a trace is written as a tag."""
    trace = rf"<trace>추적{S}+({W}+)</trace>"
    traces = F.transform(F.regexp_extract_all(_plain(c), F.lit(trace), F.lit(1)), lambda x: F.concat(F.lit("trace_"), F.upper(x)))
    rest = F.regexp_replace(_plain(c), trace, "")
    return F.concat(traces, F.transform(F.regexp_extract_all(rest, F.lit(r"(?i)\[([a-z][a-z0-9-]*)\]"), F.lit(1)), F.lower))


def tally(items: Column) -> Column:
    """A multiset as a map from item to count."""
    count = lambda x: F.map_from_arrays(F.array_distinct(x), F.transform(F.array_distinct(x), lambda y: F.size(F.filter(x, lambda z: z == y))))
    return F.transform(F.array(items), count)[0]


def injections(c: Column, side: str) -> Column:
    """First match of each pattern that occurs: structs of pattern number, matched text and side."""
    one = [F.struct(F.lit(i).alias("pattern"), F.regexp_extract(c, "(?iud)(?:" + rx.replace(r"\s", S) + ")", 0).alias("matched"), F.lit(side).alias("side")) for i, rx in enumerate(INJECTIONS)]
    return F.filter(F.array(*one), lambda m: m["matched"] != "")


def sandbox(c: Column) -> Column:
    """The text between card tags, its own card tags escaped."""
    safe = F.replace(F.replace(c, F.lit(CARD_OPEN), F.lit(CARD_OPEN_ESCAPED)), F.lit(CARD_CLOSE), F.lit(CARD_CLOSE_ESCAPED))
    return F.concat(F.lit(CARD_OPEN + "\n"), safe, F.lit("\n" + CARD_CLOSE))


def glossary_key(c: Column) -> Column:
    return F.lower(stripped(F.replace(c, F.lit("_"), F.lit(" "))))


def id_words(c: Column) -> Column:
    return F.lower(F.translate(c, "_-", "  "))


def eval_term(c: Column) -> Column:
    """A term as scoring compares it: separators to spaces, then its tokens."""
    return F.array_join(tokens(F.translate(c, "_-", "  ")), " ")


def symbol_mangled(c: Column) -> Column:
    """Whether eval_term changes more than case, separators and spaces."""
    return eval_term(c) != F.lower(squeeze(F.translate(c, "_-", "  ")))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def squeeze_ends(c: Column) -> Column:
    """Without white space at the ends; null is empty."""
    return stripped(F.coalesce(c, F.lit("")))
