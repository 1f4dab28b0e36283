"""Errors injected into correct sentences by rules, as rows of candidates.

A rule is a column expression over the tokens and, where it needs one, the parse of a
sentence (an array of TOKEN structs, one a token). Rules that need a parse give nothing
without one, or with one of another length."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A parsed token; ``head`` is the place of its governor.
TOKEN = "struct<text:string,lemma:string,pos:string,tag:string,dep:string,head:int,morph:map<string,string>>"
CANDIDATE = "struct<start:int,end:int,correction:string,error_type:string,rule:string>"
#: A candidate with a word that must be in the dictionary, and one that mustn't.
ASKING = "struct<start:int,end:int,correction:string,error_type:string,rule:string,known:string,unknown:string>"
_NONE = f"array<{CANDIDATE}>"

# Articles, and prepositions by what learners confuse.
ARTICLES = {
    "de": (("der", "die", "das", "den", "dem", "des"), ("ein", "eine", "einen", "einem", "einer", "eines")),
    "es": (("el", "la", "los", "las"), ("un", "una", "unos", "unas")),
}
PREPOSITIONS = {
    "de": (
        ("in", "an", "auf", "über", "unter", "neben", "zwischen", "vor", "hinter"),
        ("mit", "bei", "von", "zu", "nach", "aus", "seit"),
        ("für", "um", "durch", "gegen", "ohne"),
    ),
    "es": (("por", "para"), ("a", "en", "de"), ("con", "sin")),
}

# The first neighbour of each letter on the keyboard, letters and neighbours.
KEYS = {
    "de": ("abcdefghijklmnopqrstuvwxyz", "qvxsedfgujjknbiowearzcqyxt"),
    "es": ("abcdefghijklmnñopqrstuvwxyz", "qvxsedfguhjknblioweartcqzta"),
}

# Words that a comma stands before.
SUBORDINATORS = (
    "dass", "weil", "wenn", "ob", "obwohl", "da", "damit", "als", "während", "bevor", "nachdem", "sodass", "falls", "indem", "seit", "sobald", "bis",
    "der", "die", "das", "dem", "den", "welche", "welcher", "welches", "wo",
)
COORDINATORS = ("sondern", "aber", "doch", "jedoch", "denn", "allein")

# Forms that learners exchange.
CASE_SWAP = {"dem": "den", "den": "dem", "einem": "einen", "einen": "einem"}
PRONOUN_SWAP = {"mir": "mich", "mich": "mir", "dir": "dich", "dich": "dir", "ihm": "ihn", "ihn": "ihm"}
AUXILIARIES = (("bin", "ist", "sind"), ("war", "waren"), ("habe", "hat", "haben"), ("hatte", "hatten"), ("werde", "wird", "werden"), ("wurde", "wurden"))
ADJECTIVE_ENDINGS = {"de": ("em", "en", "er", "es", "e"), "es": ("os", "as", "o", "a")}
ADJECTIVE_SWAPS = {"os": ("as", "o"), "as": ("os", "a"), "o": ("a", "os"), "a": ("o", "as")}
FINITE = ("VVFIN", "VAFIN", "VMFIN")
PARTICIPLES = ("VVPP", "VAPP", "VMPP")
SUBJECT_PRONOUNS = {"1Sing": "yo", "2Sing": "tú", "1Plur": "nosotros"}
SER_ESTAR = {
    "soy": "estoy", "estoy": "soy", "eres": "estás", "estás": "eres", "es": "está", "está": "es", "somos": "estamos", "estamos": "somos",
    "sois": "estáis", "estáis": "sois", "son": "están", "están": "son",
}
SUBJUNCTIVES = {"sea": "es", "seamos": "somos", "sean": "son", "esté": "está", "estemos": "estamos", "estén": "están"}

_LETTERS = "(?U)^\\p{L}+$"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _is_upper(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first))


def _cased(like: Column, word: Column) -> Column:
    """A word with the first letter's case of another."""
    return F.when(_is_upper(like), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 100))).otherwise(word)


class Sentence:
    """The places of a sentence, as an array that rules filter and map. A place has its
    number ``i``, the token ``w``, its lower case ``l`` and its parsed token ``t``. It is made
    of a struct (words, parse, places), so nothing is computed twice."""

    def __init__(self, bound: Column, bare: bool = False):
        #: Without a parse, rules that need one have nothing to look at.
        self.bare = bare
        self.words, self.parse, self.places = bound["words"], bound["parse"], bound["places"]

    @staticmethod
    def bind(words: Column, parse: Column | None) -> Column:
        """An array of the one struct that a sentence is made of."""
        none = F.lit(None).cast(f"array<{TOKEN}>")
        held = F.array(F.struct(words.alias("words"), (none if parse is None else parse).alias("parse")))
        held = F.transform(held, lambda s: F.struct(s["words"].alias("words"), F.when(F.size(s["parse"]) == F.size(s["words"]), s["parse"]).alias("parse")))
        return F.transform(
            held,
            lambda s: F.struct(
                s["words"].alias("words"), s["parse"].alias("parse"),
                F.transform(s["words"], lambda w, i: F.struct(i.alias("i"), w.alias("w"), F.lower(w).alias("l"), F.get(s["parse"], i).alias("t"))).alias("places"),
            ),
        )

    def word(self, at: Column) -> Column:
        """A token by its place; null outside."""
        return F.get(self.words, at)

    def between(self, begin: Column, end: Column) -> Column:
        """Tokens from ``begin`` up to ``end``, none if it isn't after."""
        return F.slice(self.words, begin + 1, F.greatest(end - begin, F.lit(0)))

    def governors(self, test: Callable[[Column, Column], Column], use: Callable[[Column], Column]) -> Column:
        """What ``use`` makes of the places that have a dependant (its parsed token and place)
        that passes the test; they are found once. A test that is null passes."""
        dependants = F.filter(F.transform(self.parse, lambda t, k: F.when((t["head"] != k) & F.coalesce(test(t, k), F.lit(True)), t["head"])), lambda h: h.isNotNull())
        return F.transform(F.array(F.array_distinct(dependants)), use)[0]

    def last(self, test: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
        """What ``use`` makes of the last place that passes the test, -1 if none does; found
        once. A test that is null passes."""
        found = F.array_max(F.transform(self.parse, lambda t, k: F.when(F.coalesce(test(t), F.lit(True)), k)))
        return F.transform(F.array(F.coalesce(found, F.lit(-1))), use)[0]

    def is_noun(self, at: Column) -> Column:
        w = self.word(at)
        return (at > 0) & _is_upper(w) & w.rlike(_LETTERS) & (F.char_length(w) > 2)

    def each(self, when: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(self.places, lambda x: F.coalesce(when(x), F.lit(False))), make)

    def many(self, when: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
        return F.flatten(self.each(when, make))


def _edit(start: Column, end: Column, text: Column, kind: Column | str, rule: Column | str, known: Column | None = None, unknown: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("correction"), as_column(kind).alias("error_type"), as_column(rule).alias("rule"),
        (none if known is None else known).alias("known"), (none if unknown is None else unknown).alias("unknown"),
    )


def _drop(kind: str, rule: str):
    return lambda x: _edit(x["i"], x["i"] + 1, F.lit(""), kind, rule)


def _put(text: Callable[[Column], Column], kind: str, rule: str, known=None, unknown=None):
    return lambda x: _edit(x["i"], x["i"] + 1, text(x), kind, rule, known(x) if known else None, unknown(x) if unknown else None)


def _others(s: Sentence, groups: tuple[tuple[str, ...], ...], kind: str, rule: str, when: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
    """Every other word of the group that a word belongs to."""
    table = F.create_map(*chain.from_iterable((F.lit(w), F.lit([x for x in g if x != w])) for g in groups for w in g))
    known = F.lit([w for g in groups for w in g])
    return s.many(lambda x: F.array_contains(known, x["l"]) & when(x), lambda x: F.transform(table[x["l"]], lambda o: _edit(x["i"], x["i"] + 1, _cased(x["w"], o), kind, rule)))


def _swap(s: Sentence, pairs: dict[str, str], kind: str, rule: str, when: Callable[[Column], Column] = lambda x: F.lit(True)) -> Column:
    table = _table(pairs)
    return s.each(lambda x: x["l"].isin(*pairs) & when(x), _put(lambda x: _cased(x["w"], table[x["l"]]), kind, rule))


def _keyboard(s: Sentence, lang: str, dictionary: bool) -> Column:
    """The neighbouring key at the first letter that has one. Where a dictionary counts,
    the slip mustn't be a word."""
    letters, neighbours = KEYS[lang]
    pattern = f"^([^{letters}]*)([{letters}])"
    slip = lambda x: (
        lambda at: F.concat(F.substring(x["w"], F.lit(1), at), F.translate(F.substring(x["l"], at + 1, F.lit(1)), letters, neighbours), F.substring(x["w"], at + 2, F.lit(1 << 20)))
    )(F.char_length(F.regexp_extract(x["l"], pattern, 1)))
    return s.each(lambda x: x["w"].rlike(_LETTERS) & (F.char_length(x["w"]) >= 4) & x["l"].rlike(pattern), _put(slip, "R:SPELL", "keyboard", unknown=slip if dictionary else None))


def _without(x: Column, ending: str) -> Column:
    return F.substring(x["w"], F.lit(1), F.char_length(x["w"]) - len(ending))


def _endings(s: Sentence, lang: str, when: Callable[[Column], Column], least: int) -> Column:
    """Adjectives with another ending in place of theirs, the first of the list that they have."""
    ends = ADJECTIVE_ENDINGS[lang]
    has = lambda x, e: F.endswith(x["l"], F.lit(e)) & (F.char_length(x["w"]) > len(e) + least)

    def swapped(k: int, ending: str) -> Column:
        others = F.lit([x for x in ends if x != ending] if lang == "de" else list(ADJECTIVE_SWAPS[ending]))

        def one(x: Column, other: Column) -> Column:
            text = F.concat(_without(x, ending), other)
            return _edit(x["i"], x["i"] + 1, text, "R:ADJ:FORM", "adjective_form", known=text if lang == "es" else None)

        return s.many(lambda x: when(x) & has(x, ending) & ~_any(has(x, p) for p in ends[:k]), lambda x: F.transform(others, lambda o: one(x, o)))

    return F.concat(*[swapped(k, e) for k, e in enumerate(ends)])


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _german(s: Sentence) -> list[Column]:
    tag = lambda x, *tags: x["t"]["tag"].isin(*tags)
    head = lambda x: F.get(s.parse, x["t"]["head"])
    case = lambda x, c, n: (x["t"]["morph"]["Case"] == c) & (x["t"]["morph"]["Number"] == n)
    after = lambda x: F.lower(s.word(x["i"] + 1))
    comma = F.lit("drop_comma")
    named = lambda x: F.when(after(x).isin(*SUBORDINATORS), "drop_comma_subordinate").when(after(x).isin(*COORDINATORS), "drop_comma_coordinating").otherwise(comma)
    swap_case, infinitive = _table(CASE_SWAP), lambda x: _cased(x["w"], x["t"]["lemma"])
    gov = lambda x: x["t"]["head"]
    clause = lambda x: F.concat(s.between(x["i"] + 1, x["i"] + 2), s.between(gov(x), gov(x) + 1), s.between(x["i"] + 2, gov(x)))
    glued = lambda x: F.concat(F.array(F.concat(x["w"], s.word(gov(x)))), s.between(gov(x) + 1, x["i"]))
    genitive = lambda ending, unless: s.each(
        lambda x: tag(x, "NN") & case(x, "Gen", "Sing") & F.endswith(x["w"], F.lit(ending)) & (F.char_length(x["w"]) > len(ending) + 2) & unless(x),
        _put(lambda x: _without(x, ending), "R:NOUN:FORM", "genitive_s", known=lambda x: _without(x, ending)),
    )
    free = [
        _others(s, ARTICLES["de"], "R:DET:FORM", "article_form"),
        _others(s, PREPOSITIONS["de"], "R:ADP", "preposition"),
        s.each(lambda x: x["l"].isin(*[w for g in ARTICLES["de"] for w in g]), _drop("M:DET", "drop_article")),
        s.each(lambda x: x["w"] == ",", lambda x: _edit(x["i"], x["i"] + 1, F.lit(""), "M:PUNCT", named(x))),
        s.each(lambda x: F.contains(x["w"], F.lit("ß")), _put(lambda x: F.replace(x["w"], F.lit("ß"), F.lit("ss")), "R:SPELL", "sharp_s")),
        s.each(lambda x: x["w"].rlike("[äöüÄÖÜ]"), _put(lambda x: F.translate(x["w"], "äöüÄÖÜ", "aouAOU"), "R:SPELL", "umlaut")),
        s.each(lambda x: x["w"].isin("das", "dass", "Das", "Dass"), _put(lambda x: _cased(x["w"], F.when(x["l"] == "das", "dass").otherwise("das")), "R:OTHER", "das_dass")),
        _keyboard(s, "de", False),
        _swap(s, PRONOUN_SWAP, "R:PRON:FORM", "pronoun_form"),
        s.each(lambda x: x["l"].isin(*PREPOSITIONS["de"][0]) & after(x).isin(*CASE_SWAP), lambda x: _edit(x["i"] + 1, x["i"] + 2, _cased(s.word(x["i"] + 1), swap_case[after(x)]), "R:DET:FORM", "two_way_case")),
    ]
    return free if s.bare else free + [
        s.each(lambda x: tag(x, "NN") & s.is_noun(x["i"]), _put(lambda x: x["l"], "R:ORTH", "noun_case")),
        _endings(s, "de", lambda x: tag(x, "ADJA") & (x["w"] == x["l"]) & s.is_noun(x["i"] + 1), 2),
        s.each(lambda x: tag(x, "KOUS") & head(x)["tag"].isin(*FINITE) & (gov(x) > x["i"] + 3), lambda x: _edit(x["i"] + 1, gov(x) + 1, F.array_join(clause(x), " "), "R:WO", "verb_final")),
        s.each(lambda x: tag(x, "PTKVZ") & head(x)["tag"].isin(*FINITE) & (gov(x) < x["i"]), lambda x: _edit(gov(x), x["i"] + 1, F.array_join(glued(x), " "), "R:WO", "separable_prefix")),
        s.each(lambda x: (x["i"] > 0) & (tag(x, "PRF") | (tag(x, "PPER") & (x["t"]["dep"] == "sb"))), _drop("M:PRON", "drop_pronoun")),
        s.each(lambda x: (x["i"] > 0) & tag(x, "APPR"), _drop("M:ADP", "drop_preposition")),
        _others(s, AUXILIARIES, "R:AUX:FORM", "auxiliary_form", lambda x: tag(x, "VAFIN")),
        s.governors(
            lambda c, _: F.coalesce(c["tag"].isin(*PARTICIPLES), F.lit(False)),
            lambda heads: s.each(lambda x: (x["i"] > 0) & tag(x, "VAFIN") & F.array_contains(heads, x["i"]), _drop("M:AUX", "drop_auxiliary")),
        ),
        s.each(
            lambda x: tag(x, "VVFIN", "VMFIN") & (x["t"]["lemma"] != "") & (F.lower(x["t"]["lemma"]) != x["l"]),
            lambda x: _edit(x["i"], x["i"] + 1, infinitive(x), F.when(tag(x, "VMFIN"), "R:AUX:FORM").otherwise("R:VERB:FORM"), "verb_infinitive", known=x["t"]["lemma"]),
        ),
        # -es before -s: of both, the dictionary's first one counts (see with_dictionary)
        genitive("es", lambda x: F.lit(True)),
        genitive("s", lambda x: F.lit(True)),
        s.each(
            lambda x: tag(x, "NN") & case(x, "Dat", "Plur") & F.endswith(x["w"], F.lit("n")) & (F.char_length(x["w"]) > 4),
            _put(lambda x: _without(x, "n"), "R:NOUN:FORM", "dative_plural_n", known=lambda x: _without(x, "n")),
        ),
        s.governors(
            lambda c, k: (c["dep"] == "sb") & (k < c["head"]),
            lambda heads: s.each(
                lambda x: tag(x, *FINITE) & (x["t"]["dep"] == "ROOT") & (x["i"] > 0) & (s.word(x["i"] - 1) != ",") & ~F.array_contains(heads, x["i"]),
                lambda x: _edit(x["i"], x["i"], F.lit(","), "U:PUNCT", "comma_after_fronted"),
            ),
        ),
        s.last(
            lambda t: t["tag"].isin(*FINITE),
            lambda finite: s.each(
                lambda x: tag(x, "KON") & x["l"].isin("und", "oder") & (x["i"] > 0) & (s.word(x["i"] - 1) != ",") & (finite <= x["i"]),
                lambda x: _edit(x["i"], x["i"], F.lit(","), "U:PUNCT", "comma_before_und"),
            ),
        ),
    ]


def _spanish(s: Sentence) -> list[Column]:
    pos = lambda x, *tags: x["t"]["pos"].isin(*tags)
    morph = lambda x, name: x["t"]["morph"][name]
    articles, pronouns = [w for g in ARTICLES["es"] for w in g], _table(SUBJECT_PRONOUNS)
    person = lambda x: F.concat(morph(x, "Person"), morph(x, "Number"))
    before = lambda x: s.between(F.greatest(x["i"] - 4, F.lit(0)), x["i"])
    free = [
        s.each(lambda x: x["w"].rlike("[áéíóúÁÉÍÓÚ]"), _put(lambda x: F.translate(x["w"], "áéíóúÁÉÍÓÚ", "aeiouAEIOU"), "R:ORTH", "drop_accent")),
        _keyboard(s, "es", True),
        s.each(lambda x: x["w"].isin("¿", "¡"), _drop("M:PUNCT", "drop_inverted_punctuation")),
        _others(s, PREPOSITIONS["es"], "R:ADP", "preposition"),
    ]
    return free if s.bare else free + [
        _others(s, ARTICLES["es"], "R:DET:FORM", "article_form", lambda x: pos(x, "DET")),
        s.each(lambda x: pos(x, "DET") & x["l"].isin(*articles), _drop("M:DET", "drop_article")),
        _endings(s, "es", lambda x: pos(x, "ADJ"), 2),
        s.each(lambda x: (x["i"] > 0) & pos(x, "ADP") & ~x["l"].isin("al", "del"), _drop("M:ADP", "drop_preposition")),
        s.governors(
            lambda c, _: c["dep"].isin("nsubj", "nsubj:pass", "expl"),
            lambda heads: s.each(
                lambda x: (x["i"] > 0) & pos(x, "VERB", "AUX") & (morph(x, "VerbForm") == "Fin") & person(x).isin(*SUBJECT_PRONOUNS) & ~F.array_contains(heads, x["i"]),
                lambda x: _edit(x["i"], x["i"], pronouns[person(x)], "U:PRON", "redundant_subject_pronoun"),
            ),
        ),
        s.each(lambda x: (x["i"] > 0) & pos(x, "PRON") & x["t"]["dep"].isin("obj", "iobj", "expl"), _drop("M:PRON", "drop_object_clitic")),
        _swap(s, SER_ESTAR, "R:AUX", "ser_estar", lambda x: pos(x, "AUX") & (x["t"]["dep"] == "cop") & (F.get(s.parse, x["t"]["head"])["pos"] != "PROPN")),
        _swap(s, SUBJUNCTIVES, "R:AUX:FORM", "subjunctive_for_indicative", lambda x: pos(x, "AUX") & (morph(x, "Mood") == "Sub") & F.exists(before(x), lambda w: F.lower(w) == "que")),
        s.each(
            lambda x: pos(x, "VERB", "AUX") & (morph(x, "VerbForm") == "Fin") & ~x["t"]["lemma"].isin("ser", "estar", "haber", "") & (F.lower(x["t"]["lemma"]) != x["l"]),
            _put(lambda x: _cased(x["w"], x["t"]["lemma"]), "R:VERB:FORM", "verb_infinitive", known=lambda x: x["t"]["lemma"]),
        ),
    ]


#: Rules by language; a further one is registered by ``RULES[lang].append``.
RULES: dict[str, list[Callable[[Sentence], list[Column]]]] = {"de": [_german], "es": [_spanish]}


def register(lang: str):
    """A decorator for a rule of one's own: a function from a Sentence to arrays of ASKING."""

    def add(rule: Callable[[Sentence], list[Column]]):
        RULES.setdefault(lang, []).append(rule)
        return rule

    return add


def asking(words: Column, lang: str, parse: Column | None = None) -> Column:
    """All candidates of a language's rules with what they ask of the dictionary."""
    every = lambda s: F.concat(*[F.coalesce(p, F.array().cast(f"array<{ASKING}>")) for rule in RULES[lang] for p in rule(Sentence(s, parse is None))])
    return F.transform(Sentence.bind(words, parse), every)[0]


def candidates(words: Column, lang: str, parse: Column | None = None) -> Column:
    """All candidate errors of the rules of a language, as an array of CANDIDATE structs
    over the correct tokens; those that need a dictionary are left out."""
    free = F.filter(asking(words, lang, parse), lambda c: c["known"].isNull() & c["unknown"].isNull())
    return F.transform(free, lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "correction", "error_type", "rule")]))


def exploded(rows: DataFrame, found: Column, *columns: str) -> DataFrame:
    """``columns`` and ``c``, each of the structs of an array. The planner puts a filter on
    its size below an inner explode, which would find the array again; not below this one."""
    return rows.select(*columns, F.explode_outer(found).alias("c")).where("c is not null")


def with_dictionary(rows: DataFrame, dictionary: DataFrame, words: str = "tokens", parse: str | None = None, lang: str = "de") -> DataFrame:
    """Rows (sid, start, end, correction, error_type, rule): every candidate that the
    dictionary (column ``word``) allows. Where a genitive may lose -es or -s, it loses -es
    if that leaves a word. The dictionary is joined, so it may be of any size."""
    found = exploded(rows, asking(F.col(words), lang, F.col(parse) if parse else None), "sid").select("sid", "c.*")
    entries = dictionary.select("word").distinct()
    for asked, told in (("known", "is_known"), ("unknown", "is_word")):
        # most candidates ask nothing: what they meet by is their own, else all would meet in one task
        own = F.coalesce(F.col(asked), F.concat_ws(" ", F.lit(""), F.col("sid").cast("string"), F.col("start").cast("string")))
        found = found.withColumn("_key", own).join(entries.select(F.col("word").alias("_key"), F.lit(True).alias(told)), "_key", "left").drop("_key")
    found = found.where((F.col("known").isNull() | F.col("is_known")) & (F.col("unknown").isNull() | F.col("is_word").isNull()))
    one, many = found.where("rule <> 'genitive_s'"), found.where("rule = 'genitive_s'")
    shortest = many.groupBy("sid", "start", "end", "error_type", "rule").agg(F.min_by("correction", F.char_length("correction")).alias("correction"))
    columns = ("sid", "start", "end", "correction", "error_type", "rule")
    return one.select(*columns).unionByName(shortest.select(*columns))


def silent_rules(rows: DataFrame, expected: list[str]) -> list[str]:
    """The expected rules that no candidate row has, in order."""
    seen = {r.rule for r in rows.select("rule").distinct().collect()}
    return sorted(set(expected) - seen)


def choose(rows: DataFrame, salt: str, most: int = 2) -> DataFrame:
    """Up to ``most`` candidates of each row, seeded: first a type by hash, then a candidate
    of that type by hash, without overlaps. Rows have ``sid`` and ``candidates``; the chosen
    ones come in the order of start."""
    digest = lambda *c: F.sha2(F.concat_ws(":", F.lit(salt), F.col("sid").cast("string"), *c), 256)
    keyed = F.transform("candidates", lambda c: F.struct(digest(c["error_type"]).alias("t"), digest(c["error_type"], c["start"].cast("string"), c["correction"], c["rule"]).alias("h"), c.alias("c")))
    # one candidate of each type, types by their hash
    pick = lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i - 1)["t"] != x["t"], F.lit(True)))
    # held in an array of one, the sorted list is made once
    firsts = F.transform(F.array(F.array_sort(keyed)), pick)[0]

    def take(got: Column, x: Column) -> Column:
        clash = F.exists(got, lambda g: (x["c"]["start"] < g["end"]) & (g["start"] < x["c"]["end"]))
        return F.when((F.size(got) >= most) | clash, got).otherwise(F.array_append(got, x["c"]))

    return rows.withColumn("chosen", F.array_sort(F.aggregate(firsts, F.array().cast(_NONE), take)))
