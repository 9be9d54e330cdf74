"""Column functions over names, URIs and descriptions. Each takes and returns columns unless its text says otherwise."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words that carry no meaning in descriptions (fixed values).
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "of", "to", "for", "with", "as", "this", "that", "these", "those")
#: Prepositions that are left out inside a phrase, that are kept anywhere, and that pair with other words (fixed values).
INNER, OUTER, PAIRED = ("of", "to", "from"), ("in", "at", "by"), ("in", "at", "by", "from", "during")
VOWELS = "aeiou"


def last_part(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def strip_brackets(uri: Column) -> Column:
    """without angle brackets and outer white space."""
    return F.trim(F.btrim(uri, F.lit("<>")))


def uri_to_label(uri: Column) -> Column:
    """``.../yearOf_Publication`` -> ``year of publication``."""
    bare = F.btrim(uri, F.lit("<>"))
    tail = F.when(F.contains(bare, F.lit("#")), last_part(bare, "#")).otherwise(last_part(bare, "/"))
    spaced = F.regexp_replace(tail, "([a-z])([A-Z])", "$1 $2")
    return F.trim(F.lower(F.translate(spaced, "_-", "  ")))


def relation_name(uri: Column) -> Column:
    """after the last ``#``, else after the last ``/``, else as it is."""
    return F.when(F.contains(uri, F.lit("#")), last_part(uri, "#")).otherwise(last_part(uri, "/"))


def tail_label(uri: Column) -> Column:
    """the part after the last ``#``, of that the part after the last ``/``."""
    return last_part(last_part(uri, "#"), "/")


def node_tail(uri: Column) -> Column:
    """G4's fallback: the part after the last ``/``, of that the part after the last ``#``."""
    return last_part(last_part(uri, "/"), "#")


def is_node(term: Column) -> Column:
    return F.startswith(term, F.lit("http://")) | F.startswith(term, F.lit("https://"))


def valid_uri(uri: Column, prefix: str | None = None) -> Column:
    """starts with the prefix, or with http(s) if none is given."""
    return F.startswith(uri, F.lit(prefix)) if prefix else is_node(uri)


def search_variants(query: Column) -> Column:
    """distinct forms of a lower-case query: as it is, without full stops, commas, or both; emptied forms go."""
    base = F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))
    tidy = lambda marks: F.trim(F.regexp_replace(F.translate(base, marks, ""), r"\s+", " "))
    forms = F.array_distinct(F.array(base, tidy("."), tidy(","), tidy(".,")))
    return F.filter(forms, lambda x, i: (i == 0) | (x != ""))


def camel_words(text: Column) -> Column:
    """lower-case words of a camelCase name."""
    return F.transform(F.split(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), r"\s+"), F.lower)


def _letter(word: Column, back: int) -> Column:
    return F.substr(word, F.length(word) - (back - 1), F.lit(1))


def _less(word: Column, n: int) -> Column:
    return F.substr(word, F.lit(1), F.greatest(F.length(word) - n, F.lit(0)))


def verb_base(word: Column) -> Column:
    """F8: a word without -ed or -ing; a doubled consonant before it is halved, and -ed stays -e but after h, r and t."""
    doubled = (F.length(word) > 4) & (_letter(word, 3) == _letter(word, 4)) & ~_letter(word, 4).isin(*VOWELS)
    past = F.when(doubled, _less(word, 3)).when(_letter(word, 3).isin("h", "r", "t"), _less(word, 2)).otherwise(_less(word, 1))
    lasting = F.when((F.length(word) > 4) & (_letter(word, 4) == _letter(word, 5)), _less(word, 4)).otherwise(_less(word, 3))
    return F.when(F.endswith(word, F.lit("ed")), past).when(F.endswith(word, F.lit("ing")), lasting).otherwise(word)


def verb_forms(verb: Column) -> Column:
    """the verb, its past and its -ing form."""
    silent = F.endswith(verb, F.lit("e"))
    past = F.when(silent, F.concat(verb, F.lit("d"))).when(F.endswith(verb, F.lit("y")) & (F.length(verb) > 2) & ~_letter(verb, 2).isin(*VOWELS), F.concat(_less(verb, 1), F.lit("ied"))).otherwise(F.concat(verb, F.lit("ed")))
    return F.array(verb, past, F.concat(F.when(silent & (F.length(verb) > 2), _less(verb, 1)).otherwise(verb), F.lit("ing")))


def _pairs(words: Column, preposition: str) -> Column:
    others = F.filter(words, lambda w: ~w.isin(preposition, "of", "to"))
    return F.when(F.array_contains(words, preposition), F.transform(others, lambda w: F.concat(F.lit(preposition + " "), w))).otherwise(F.array().cast("array<string>"))


def phrase_forms(words: Column) -> Column:
    """the phrase, its words, forms of its verb, and pairs of a preposition with each other word, in order of first occurrence."""
    none, n = F.array().cast("array<string>"), F.size(words)
    kept = F.filter(words, lambda w, i: ~w.isin(*INNER) | (i == 0) | (i == n - 1))
    first = F.get(words, F.lit(0))
    forms = F.when((F.length(first) > 3) & (verb_base(first) != first), verb_forms(verb_base(first))).otherwise(none)
    pairs = [_pairs(words, p) for p in PAIRED]
    return F.array_distinct(F.concat(F.array(F.array_join(words, " ")), kept, forms, *pairs))


def context_terms(domain: Column, range_: Column) -> Column:
    """the words of a relation's domain and range."""
    empty = F.array().cast("array<string>")
    own = lambda c: F.coalesce(camel_words(relation_name(c)), empty)
    return F.concat(own(domain), own(range_))


def terms_of(text: Column) -> Column:
    """lower-case words of over two letters that are no stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]+)\b"), F.lit(1))
    stops = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))


def relation_description(name: Column, domain: Column | None = None, range_: Column | None = None, labels: Column | None = None, comments: Column | None = None) -> Column:
    """name, forms of its phrase, terms of labels and comments (100 characters of each), context; case-insensitively distinct."""
    empty = F.array().cast("array<string>")
    null = F.lit(None).cast("string")
    flat = lambda texts, size: F.flatten(F.transform(F.coalesce(texts, empty), lambda t: terms_of(F.substring(t, 1, size))))
    parts = [F.array(name), phrase_forms(camel_words(name))]
    parts += [flat(labels, 1 << 30)] if labels is not None else []
    parts += [flat(comments, 100)] if comments is not None else []
    parts.append(context_terms(domain if domain is not None else null, range_ if range_ is not None else null))
    words = F.filter(F.concat(*parts), lambda w: F.length(w) > 0)
    seen = F.aggregate(words, F.array().cast("array<string>"), lambda a, w: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(w)), a).otherwise(F.concat(a, F.array(w))))
    return F.array_join(seen, " ")


def title_case(text: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def enhanced_entity_query(name: Column, types: Column) -> Column:
    """``T1 T2: name.`` or the name alone."""
    return F.when(F.size(F.coalesce(types, F.array().cast("array<string>"))) > 0, F.concat(F.array_join(types, " "), F.lit(": "), name, F.lit("."))).otherwise(name)


def enhanced_relation_query(name: Column, predicted: Column) -> Column:
    """F16: each predicted relation and its words, then the phrase."""
    spread = lambda p: F.concat_ws(" ", p, F.lower(F.trim(F.regexp_replace(p, "([A-Z])", " $1"))))
    return F.concat_ws(" ", F.array_join(F.transform(F.coalesce(predicted, F.array().cast("array<string>")), spread), " "), name) if predicted is not None else name


@F.pandas_udf(DoubleType())
def fuzzy_match(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity ratio of lower-case, trimmed texts."""
    return pd.Series([SequenceMatcher(None, str(x or "").lower().strip(), str(y or "").lower().strip()).ratio() for x, y in zip(a, b, strict=True)])


def label_score(label: str | None, name: str | None) -> float:
    """F18 for plain values: 1 if either holds the other, else the best ratio of two words, 0 without words."""
    x, y = (label or "").lower().strip(), (name or "").lower().strip()
    if x in y or y in x:
        return 1.0
    return max((SequenceMatcher(None, p, q).ratio() for p in x.split() for q in y.split()), default=0.0)


@F.pandas_udf(DoubleType())
def _label_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([label_score(x, y) for x, y in zip(a, b, strict=True)])


def fuzzy_label_score(label: Column, name: Column, exact: bool = True) -> Column:
    """F18; with exact=False only the part that needs no Python (1 or 0)."""
    x, y = F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lower(F.trim(F.coalesce(name, F.lit(""))))
    held = F.contains(x, y) | F.contains(y, x)
    return F.when(held, 1.0).otherwise(_label_score(label, name) if exact else F.lit(0.0))


def path_text(places: Column) -> Column:
    """the labels of an alternating path of nodes and relations."""
    return F.array_join(F.transform(places, lambda x: x["label"]), " ")


def uris_in(sparql: Column, pattern: str) -> Column:
    """distinct matches of a URI pattern in a query text."""
    return F.array_distinct(F.regexp_extract_all(sparql, F.lit(f"({pattern})"), F.lit(1)))


def normal_sparql(text: Column) -> Column:
    """lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def strip_fences(text: str) -> str:
    """F22, plain: a text without the code fence around it."""
    text = text.strip()
    found = re.search(r"```(?:\w+)?[ \t]*\n?(.*?)```", text, re.S)
    return (found.group(1) if found else re.sub(r"^```\w*|```$", "", text)).strip()


def question_text(question: Column) -> Column:
    """the first form of a question, else the second."""
    return F.coalesce(F.nullif(question["1"], F.lit("")), question["2"])


def seed_label(description: Column, uri: Column) -> Column:
    """between the first and second colon, up to a full stop; without colon the URI's tail."""
    inside = F.trim(F.split_part(F.split_part(description, F.lit(":"), F.lit(2)), F.lit("."), F.lit(1)))
    return F.when(F.contains(description, F.lit(":")), inside).otherwise(node_tail(uri))


def full_seed_label(description: Column, uri: Column) -> Column:
    """F24 without the cut at the full stop."""
    return F.when(F.contains(description, F.lit(":")), F.trim(F.substr(description, F.locate(":", description) + 1))).otherwise(node_tail(uri))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """A vector of length 1 in double precision; null if its norm is zero."""
    return _scaled(a, F.nullif(F.sqrt(dot(a, a)), F.lit(0.0)))


def _scaled(a: Column, norm: Column) -> Column:
    held = F.array(F.struct(a.alias("a"), norm.alias("n")))  # the norm is computed once, not for each element
    return F.get(F.transform(held, lambda h: F.when(h["n"].isNotNull(), F.transform(h["a"], lambda x: x.cast("double") / h["n"]))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """null if either norm is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def exp_cosine(a: Column, b: Column) -> Column:
    return F.exp(cosine(a, b))


def parse_mentions(text: str, query: str, types_key: str = "types") -> list[dict]:
    """F26, plain: a JSON list of mentions; a text that is none makes the whole query one mention."""
    try:
        found = json.loads(strip_fences(text))
    except (TypeError, ValueError):
        return [{"name": query, "types": []}]
    found = found if isinstance(found, list) else [found]
    return [m for m in (_mention(x, types_key) for x in found) if m["name"]]


def _mention(item, types_key: str) -> dict:
    if not isinstance(item, dict):
        return {"name": str(item).strip(), "types": []}
    types = item.get(types_key) or []
    types = [types] if isinstance(types, str) else types if isinstance(types, Iterable) else []
    return {"name": str(item.get("name") or "").strip(), "types": [t for t in (str(t).strip() for t in types) if t][:3]}


def mentions_column(text: Column, query: Column) -> Column:
    """F26 as a column, for lists of objects."""
    kind = "array<struct<name: string, types: array<string>>>"
    trimmed = F.transform(F.from_json(text, kind), lambda m: F.struct(F.trim(m["name"]).alias("name"), F.slice(F.filter(F.transform(F.coalesce(m["types"], F.array().cast("array<string>")), F.trim), lambda t: F.length(t) > 0), 1, 3).alias("types")))
    whole = F.array(F.struct(query.alias("name"), F.array().cast("array<string>").alias("types")))
    return F.coalesce(F.filter(trimmed, lambda m: F.length(m["name"]) > 0), whole)
