"""Scalar text functions as column expressions.

Letters are ``[\\p{L}\\p{N}_]`` wherever a word character is meant: unlike ``\\w`` this
keeps Devanagari vowel signs out of trouble in every engine. All functions pass null on
unless they say otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: C) -> Column:
    """Without white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def squeeze(c: C) -> Column:
    """Every run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def split_danda(c: C) -> Column:
    """Sentences that end in a danda, ``?`` or ``!`` followed by white space; blank ones go."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[।?!])\s+"), strip), lambda s: s != "")


def split_indic(c: C) -> Column:
    """Sentences that end in a danda, ``?``, ``!`` or ``.``; blank ones go."""
    return F.filter(F.transform(F.split(col(c), r"(?<=[।?!.])\s+"), strip), lambda s: s != "")


def rejoin(sentences: C) -> Column:
    """Non-empty sentences joined by a space."""
    return F.array_join(F.filter(col(sentences), lambda s: s != ""), " ")


def noise_strip(c: C) -> Column:
    """Lower case, no characters but letters, digits, white space and ``.,!?;:'-``, squeezed."""
    return squeeze(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{M}\p{N}_\s.,!?;:'\-]", ""))


def itrans_to_casual(c: C) -> Column:
    """ITRANS conventions to everyday spelling; the order of the steps matters."""
    steps = [(r"\.m", "n"), ("ँ", "n"), ("aa", "a"), ("ii", "i"), ("uu", "u"), (r"\.a", "")]
    out = reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, col(c))
    # Aspirates first, then what is left of the capitals.
    out = reduce(lambda x, p: F.replace(x, F.lit(p), F.lit(p.lower())), ["Th", "Dh", "Ph", "Kh", "Gh", "Ch", "Jh", "Bh", "Rh"], out)
    return F.translate(out, "TDNRSL", "tdnrsl")


def schwa_deletion(c: C, keep: list[str] = lx.SCHWA_EXCEPTIONS) -> Column:
    """Drops a word's final ``a`` after a consonant, but for the words to keep; one pass over the text."""
    end = r"(?=[.,!?;:]*(?: |\z))"
    spared = rf"(?!(?i:{'|'.join(sorted(set(keep)))}){end})" if keep else ""
    return F.regexp_replace(col(c), rf"(?<![^ ]){spared}([a-zA-Z]*[bcdfghjklmnpqrstvwxyz])a{end}", "$1")


def word_fixes(c: C) -> Column:
    """Whole words replaced, whatever their case."""
    return reduce(lambda x, kv: F.regexp_replace(x, rf"(?i)\b{kv[0]}\b", kv[1]), lx.WORD_FIXES.items(), col(c))


def smooth_roman(c: C, keep: list[str] = lx.SCHWA_EXCEPTIONS) -> Column:
    """ITRANS text to clean casual romanization."""
    return noise_strip(word_fixes(schwa_deletion(itrans_to_casual(c), keep)))


def has_cue(c: C, cues: list[str], whole_word: bool = False) -> Column:
    """Whether any cue stands in the text: as a substring, or as whole words."""
    low = F.lower(col(c))
    if whole_word:
        return low.rlike(r"\b(" + "|".join(cues) + r")\b")
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(q)) for q in cues])


def words(c: C) -> Column:
    """``[a-z]+`` of the text in lower case; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def token_count(c: C) -> Column:
    """Stretches between white space."""
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"\S+"))


def nonblank_lines(c: C) -> Column:
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\r\n|\n|\r"), lambda s: strip(s) != "")


def dialogue_line(c: C) -> Column:
    """speaker and utterance around the first colon; without one the line is kept whole."""
    line, cut = col(c), r"^([^:]*):([\s\S]*)$"
    has = F.contains(line, F.lit(":"))
    return F.struct(
        F.when(has, strip(F.regexp_extract(line, cut, 1))).alias("speaker"),
        F.when(has, strip(F.regexp_extract(line, cut, 2))).otherwise(line).alias("utterance"),
        has.alias("is_dialogue"),
    )


def strip_speaker(c: C) -> Column:
    """What follows the first colon if it stands among the first 20 characters."""
    line = col(c)
    return F.when(F.contains(F.substring(line, 1, 20), F.lit(":")), F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1)).otherwise(line)


def keep_first_ignoring_case(items: C) -> Column:
    """An array without later items that differ in case only."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"))
    merge = lambda acc, x: F.when(F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(
        F.struct(F.array_append(acc["out"], x).alias("out"), F.array_append(acc["seen"], F.lower(x)).alias("seen"))
    )
    return F.aggregate(col(items), start, merge, lambda acc: acc["out"])


def slang_list(c: C, separators: str = r"[,/]") -> Column:
    """Items of a list without glosses in brackets, squeezed, the first of each whatever its case."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separators), lambda p: squeeze(F.regexp_replace(p, r"\(.*?\)", "")))
    return keep_first_ignoring_case(F.filter(parts, lambda p: p != ""))


def positions(c: C) -> Column:
    """START, MIDDLE and END that a list names, END if it names none."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), "[,/]"), lambda p: F.upper(strip(p)))
    named = F.array_distinct(F.filter(parts, lambda p: p.isin("START", "MIDDLE", "END")))
    return F.when(F.size(named) == 0, F.array(F.lit("END"))).otherwise(named)


def control_token(c: C) -> Column:
    """Upper case, no square brackets at the ends, spaces as underscores."""
    return F.replace(F.upper(F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", "")), F.lit(" "), F.lit("_"))


def function_name(c: C) -> Column:
    """What stands before a plus, in lower case with underscores; ``filler`` if nothing does."""
    base = F.regexp_replace(F.lower(strip(F.split_part(F.coalesce(col(c), F.lit("")), F.lit("+"), F.lit(1)))), r"\s+", "_")
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("filler"))


def lookup(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def canonical_control(c: C) -> Column:
    return lookup(control_token(F.coalesce(col(c), F.lit(""))), lx.CANONICAL_CONTROLS, "ASSERT_NEUTRAL")


def dedup_key(c: C) -> Column:
    """Lower case, letters a-z, digits and spaces only, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", ""))


def neutral_of(c: C) -> Column:
    """The third part of ``task | control | neutral``, bars inside the neutral kept; else the last part."""
    parts = F.split(col(c), r" \| ", 3)
    return strip(F.element_at(parts, -1))


def unwrap(c: C) -> Column:
    """Drops a last token that repeats the first one, if that ends in a comma."""
    t = F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda x: x != "")
    first, last = F.lower(F.get(t, F.lit(0))), F.lower(F.regexp_replace(F.element_at(t, -1), "[.,!?]+$", ""))
    wrapped = (F.size(t) >= 3) & F.endswith(first, F.lit(",")) & (F.regexp_replace(first, ",+$", "") == last)
    return F.when(wrapped, F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " ")).otherwise(col(c))


def model_line(c: C) -> Column:
    """The first line of a reply without quotes and without a short heading before a colon."""
    line = F.regexp_replace(strip(F.split_part(strip(F.coalesce(col(c), F.lit(""))), F.lit("\n"), F.lit(1))), "^[\"']+|[\"']+$", "")
    head = F.regexp_extract(line, r"^([^:]*):", 1)
    titled = (head != "") & (token_count(head) <= 2) & ((head == F.upper(head)) | (head == F.initcap(head)))
    return F.when(titled, strip(F.regexp_extract(line, r"^[^:]*:([\s\S]*)$", 1))).otherwise(line)


def bare_json(c: C, opening: str, closing: str) -> Column:
    """The widest JSON text between two brackets, without code fences and trailing commas; "" if none."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "```(?:json)?", "")
    found = F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0)
    return F.regexp_replace(found, r",(\s*[}\]])", "$1")


def json_objects(c: C, schema: str) -> Column:
    """An array of records from a reply that holds a JSON array or a single object; null if neither parses.

    A reply whose first bracket opens an object is read as one.
    """
    text, want = strip(F.coalesce(col(c), F.lit(""))), f"array<struct<{schema}>>"
    obj = bare_json(text, "{", "}")
    array = F.when(F.regexp_extract(text, r"[\[{]", 0) == "{", F.concat(F.lit("["), obj, F.lit("]"))).otherwise(bare_json(text, "[", "]"))
    return F.when(F.try_parse_json(array).isNotNull() & (array != "[]"), F.from_json(array, want))


def json_object(c: C, schema: str) -> Column:
    """A record from a reply that holds a JSON object; null if it doesn't parse."""
    obj = bare_json(c, "{", "}")
    return F.when((obj != "") & F.try_parse_json(obj).isNotNull(), F.from_json(obj, f"struct<{schema}>"))


def intent_label(c: C) -> Column:
    """The first stretch of capitals in a reply if it is an intent, else the permissive default."""
    label = F.regexp_extract(F.upper(F.coalesce(col(c), F.lit(""))), "[A-Z_]+", 0)
    return F.when(label.isin(lx.INTENTS), label).otherwise(F.lit("CASUAL_ASSERTION"))


def has_devanagari(c: C) -> Column:
    return col(c).rlike(r"[ऀ-ॿ]")


def render(template: str, **slots: C) -> Column:
    """A template with ``{named}`` slots filled; null slots are empty."""
    out = F.lit(template)
    for name, c in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col(c), F.lit("")))
    return out


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` mentions it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def code_mixing(c: C) -> Column:
    """cmi, en_ratio and hi_ratio of a text: English by list, the rest as the other language."""

    def shares(counts: Column) -> Column:
        n, en = counts["n"], counts["en"]
        some, safe = n > 0, F.greatest(n, F.lit(1))
        return F.struct(
            F.when(some, F.round(100.0 * (n - F.greatest(en, n - en)) / safe, 2)).otherwise(0.0).alias("cmi"),
            F.when(some, F.round(en / safe, 3)).otherwise(0.0).alias("en_ratio"),
            F.when(some, F.round((n - en) / safe, 3)).otherwise(0.0).alias("hi_ratio"),
        )

    counts = bound(words(c), lambda w: F.struct(F.size(w).alias("n"), F.size(F.filter(w, lambda x: x.isin(lx.ENGLISH_WORDS))).alias("en")))
    return bound(counts, shares)


# Prompts of the model steps, in our own words.
PROMPTS = {
    "events": "Story so far: {previous}\nScene: {scene}\nReply with a JSON array of one object: scene_id, key_events, characters, scene_goal, location, narrative_link, pronoun_map.",
    "dialogue": "Scene goal: {goal}\nWhat happens: {events}\nWrite at most three short lines of talk between {speaker} and {listener}.",
    "placement": "Line: {line}\nWork exactly one of these into it and change nothing else: {candidates}",
    "intent": "Name the one intent of this line, out of {labels}.\nLine: {line}",
    "edit": "insert slang | control: {control} | {line}",  # fixed value: the form that editor examples have
    "insert": "Line: {neutral}\nWork the expression {slang} into it and change nothing else. Reply with a JSON object: output.",
    "novel": "Setting: {context}. Write a plain line for the mood {control}, and the same line with the expression {slang}. Reply with a JSON object: neutral, output.",
    "verdict": "Plain: {neutral}\nWith {slang}: {output}\nMood: {control}\nReply with a JSON object of booleans: is_hinglish, grammatical, meaning_preserved, intent_match, is_real_slang.",
    "judge": "Rate from 1 to 5 how the added expressions fit the mood and the place. Scene: {scene}\nReply with a JSON object: emotion_fit, placement.",
}
