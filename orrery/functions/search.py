"""Full-text search: a tsvector is array<struct(lexeme, positions)>, sorted by lexeme.

A position is struct(at, weight), with weights A to D. The parser takes words of letters and digits; the `simple`
configuration lowers them, `english` also drops stop words and takes off common endings. Vectors are
put together by batches of rows, all else is column expressions, in time linear in the text but for the sort of its words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[\p{L}\p{N}]+"
#: Common English words that are not indexed: fixed values, those of the Snowball project's English list.
STOP_WORDS = tuple("i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split())
#: Plural endings, then verbs' endings: a pattern of the whole word, of which the groups stay.
ENDINGS = (r"^(?:(.*(?:ss|x|ch|sh|zz))es|(.*i)es|(.*[^su])s)$", r"^(.*[aeiouy].*)(?:ing|ed)$")
#: Weights of positions D, C, B and A in ranks: fixed values.
WEIGHTS = (0.1, 0.2, 0.4, 1.0)

VECTOR = "array<struct<lexeme:string,positions:array<struct<at:int,weight:string>>>>"
_NOWHERE = "array<struct<at:int,weight:string>>"


def _lexeme(w: str, config: str) -> str:
    """A word's lexeme; empty for a stop word."""
    w = w.lower()
    if config == "simple":
        return w
    if w in STOP_WORDS:
        return ""
    for pattern in ENDINGS:
        w = re.sub(pattern, lambda m: "".join(g or "" for g in m.groups()), w)
    return w


def lexeme(word: Column, config: str = "english") -> Column:
    """A word's lexeme; empty for a stop word."""
    low = F.lower(word)
    if config == "simple":
        return low
    stem = F.regexp_replace(F.regexp_replace(low, ENDINGS[0], "$1$2$3"), ENDINGS[1], "$1")
    return F.when(low.isin(*STOP_WORDS), "").otherwise(stem)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def parse(text: Column) -> Column:
    """ts_parse(): the words."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lexize(word: Column, config: str = "english") -> Column:
    """ts_lexize(): an empty array for a stop word."""
    return F.filter(F.array(lexeme(word, config)), lambda x: x != "") if config == "simple" else F.when(word.isNotNull(), F.filter(F.array(lexeme(word, config)), lambda x: x != ""))


def _gathered(places: Column) -> Column:
    """A vector of struct(lexeme, at, weight): sorted, then cut where the lexeme changes."""

    def runs(own: Column) -> Column:
        lex = lambda i: F.get(own, i - 1)["lexeme"]
        starts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (lex(i) != lex(i - 1)))

        def cut(at: Column) -> Column:
            def run(a: Column, k: Column) -> Column:
                past = F.coalesce(F.get(at, k + 1), F.size(own) + 1)
                where = F.filter(F.transform(F.slice(own, a, past - a), lambda x: F.struct(x["at"].alias("at"), x["weight"].alias("weight"))), lambda x: x["at"].isNotNull())
                return F.struct(lex(a).alias("lexeme"), where.alias("positions"))

            return F.transform(at, run)

        return F.when(F.size(own) > 0, _bound(starts, cut)).otherwise(F.array().cast(VECTOR))

    return _bound(F.sort_array(places), runs)


def _vectors(words: pa.Array) -> pa.Array:
    """A vector for each row's lexemes, of which empty ones go, as _gathered() does it: their ranks sorted, then cut where the lexeme changes."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    flat = words.flatten()
    row = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(1, len(flat) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = flat.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    kept = np.flatnonzero(pc.not_equal(flat, "").to_numpy(zero_copy_only=False))
    key = (row * len(rank) + rank[coded.indices.to_numpy()])[kept]
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    order = kept[order]
    places = pa.StructArray.from_arrays([pa.array(at[order].astype(np.int32)), pa.repeat("D", len(order))], ["at", "weight"])
    where = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), places)
    lexeme = coded.dictionary.take(coded.indices.take(pa.array(order[starts])))
    ends = np.concatenate(([0], np.cumsum(np.bincount(row[order[starts]], minlength=len(words))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([lexeme, where], ["lexeme", "positions"]), mask=words.is_null())


def to_tsvector(text: Column, config: str = "english") -> Column:
    """Lexemes and their positions; null for a null text.

    Batches of rows are worked out in Python, so it can't stand in a lambda. It is not taken for deterministic, so that
    what asks for a vector, or filters by it, does not have it worked out again.
    """
    return F.arrow_udf(_vectors, VECTOR).asNondeterministic()(F.transform(parse(text), lambda w: lexeme(w, config)))


def array_to_tsvector(words: Column) -> Column:
    """The distinct elements as lexemes without positions."""
    return F.transform(F.array_sort(F.array_distinct(words)), lambda w: F.struct(w.alias("lexeme"), F.array().cast(_NOWHERE).alias("positions")))


def lexemes(vector: Column) -> Column:
    """tsvector_to_array()."""
    return F.transform(vector, lambda e: e["lexeme"])


def strip(vector: Column) -> Column:
    return F.transform(vector, lambda e: F.struct(e["lexeme"].alias("lexeme"), F.array().cast(_NOWHERE).alias("positions")))


def delete(vector: Column, lexeme: str | Sequence[str]) -> Column:
    gone = [lexeme] if isinstance(lexeme, str) else list(lexeme)
    return F.filter(vector, lambda e: ~e["lexeme"].isin(*gone))


def length(vector: Column) -> Column:
    return F.size(vector)


def setweight(vector: Column, weight: str, only: Sequence[str] | None = None) -> Column:
    """All positions (or those of some lexemes) with that weight."""

    def put(e: Column) -> Column:
        new = F.transform(e["positions"], lambda p: F.struct(p["at"].alias("at"), F.lit(weight.upper()).alias("weight")))
        own = F.struct(e["lexeme"].alias("lexeme"), new.alias("positions"))
        return own if only is None else F.when(e["lexeme"].isin(*only), own).otherwise(e)

    return F.transform(vector, put)


def ts_filter(vector: Column, weights: Sequence[str]) -> Column:
    """Lexemes at positions of those weights, and these positions."""
    kept = [w.upper() for w in weights]
    some = F.filter(vector, lambda e: F.exists(e["positions"], lambda p: p["weight"].isin(*kept)))
    return F.transform(some, lambda e: F.struct(e["lexeme"].alias("lexeme"), F.filter(e["positions"], lambda p: p["weight"].isin(*kept)).alias("positions")))


def concat(a: Column, b: Column) -> Column:
    """a || b: the positions of b follow those of a."""

    def places(v: Column, ahead: Column) -> Column:
        none = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("weight")))

        def each(e: Column) -> Column:
            where = F.when(F.size(e["positions"]) > 0, e["positions"]).otherwise(none)
            return F.transform(where, lambda p: F.struct(e["lexeme"].alias("lexeme"), (p["at"] + ahead).alias("at"), p["weight"].alias("weight")))

        return F.flatten(F.transform(v, each))

    def both(v: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(F.flatten(F.transform(v["a"], lambda e: e["positions"])), lambda p: p["at"])), F.lit(0))
        return _gathered(F.concat(places(v["a"], F.lit(0)), places(v["b"], last)))

    return _bound(F.struct(a.alias("a"), b.alias("b")), both)


def show(vector: Column) -> Column:
    """The text form: 'word':1A,2 'other':3."""
    where = lambda p: F.concat(p["at"].cast("string"), F.when(p["weight"] == "D", "").otherwise(p["weight"]))
    each = lambda e: F.concat(F.lit("'"), F.replace(e["lexeme"], F.lit("'"), F.lit("''")), F.lit("'"), F.when(F.size(e["positions"]) > 0, F.concat(F.lit(":"), F.array_join(F.transform(e["positions"], where), ","))).otherwise(""))
    return F.array_join(F.transform(vector, each), " ")


class Query:
    """A parsed tsquery: words (with weights that they may have) with & | ! and <-> or <n>."""

    def __init__(self, kind: str, *parts: Query, word: str = "", prefix: bool = False, distance: int = 1, weights: str = "") -> None:
        self.kind, self.parts, self.word, self.prefix, self.distance, self.weights = kind, parts, word, prefix, distance, weights

    def nodes(self) -> int:
        """numnode()."""
        return 1 + sum(p.nodes() for p in self.parts)

    def words(self) -> list[str]:
        return [self.word] if self.kind == "word" else [w for p in self.parts for w in p.words()]

    def leaves(self) -> list[Query]:
        return [self] if self.kind == "word" else [w for p in self.parts for w in p.leaves()]

    def __str__(self) -> str:
        if self.kind == "word":
            marks = "*" * self.prefix + self.weights
            return f"'{self.word}'" + (f":{marks}" if marks else "")
        if self.kind == "!":
            return f"!{self.parts[0]}" if self.parts[0].kind == "word" else f"!( {self.parts[0]} )"
        sign = f"<{'-' if self.distance == 1 else self.distance}>" if self.kind == "<>" else self.kind
        return f" {sign} ".join(f"( {p} )" if p.kind == "|" and self.kind != "|" else str(p) for p in self.parts)


def _joined(kind: str, words: list[str], config: str) -> Query | None:
    own = [Query("word", word=x) for x in (_lexeme(w, config) for w in words) if x]
    out = own[0] if own else None
    for w in own[1:]:
        out = Query(kind, out, w)
    return out


def plainto_tsquery(text: str, config: str = "english") -> Query | None:
    return _joined("&", re.findall(r"\w+", text), config)


def phraseto_tsquery(text: str, config: str = "english") -> Query | None:
    return _joined("<>", re.findall(r"\w+", text), config)


def to_tsquery(text: str, config: str = "english") -> Query | None:
    """Operators by rising strength: | & <-> !; :* asks for a prefix, :AB for positions of weight A or B."""
    tokens = re.findall(r"<->|<\d+>|[&|!()]|\w+(?::[*A-Da-d]+)?", text)
    at = 0

    def level(signs: tuple[str, ...], below) -> Query | None:
        nonlocal at
        out = below()
        while at < len(tokens) and (tokens[at] in signs or ("<" in signs and tokens[at].startswith("<"))):
            sign = tokens[at]
            at += 1
            other = below()
            if out is None or other is None:
                out = out or other
            elif sign.startswith("<"):
                out = Query("<>", out, other, distance=1 if sign == "<->" else int(sign[1:-1]))
            else:
                out = Query(sign, out, other)
        return out

    def unary() -> Query | None:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"syntax error in tsquery: {text}")
        t = tokens[at]
        at += 1
        if t == "!":
            inner = unary()
            return inner and Query("!", inner)
        if t == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"syntax error in tsquery: {text}")
            at += 1
            return inner
        word, _, marks = t.partition(":")
        lex = _lexeme(word, config)
        return Query("word", word=lex, prefix="*" in marks, weights="".join(sorted(set(marks.upper()) - {"*"}))) if lex else None

    def either() -> Query | None:
        return level(("|",), lambda: level(("&",), lambda: level(("<",), unary)))

    out = either()
    if at != len(tokens):
        raise ValueError(f"syntax error in tsquery: {text}")
    return out


def websearch_to_tsquery(text: str, config: str = "english") -> Query | None:
    """Quoted phrases, `or`, and - for not."""
    out: Query | None = None
    alternative = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\w+))', text):
        if word.lower() == "or" and not minus:
            alternative = True
            continue
        part = phraseto_tsquery(phrase, config) if phrase else plainto_tsquery(word, config)
        if part is None:
            continue
        part = Query("!", part) if minus else part
        out = part if out is None else Query("|" if alternative else "&", out, part)
        alternative = False
    return out


def _same(q: Query) -> Callable[[Column], Column]:
    return (lambda e: e["lexeme"].startswith(q.word)) if q.prefix else (lambda e: e["lexeme"] == q.word)


def _places(vector: Column, q: Query) -> Column:
    """Positions and weights of a word."""
    found = F.flatten(F.transform(F.filter(vector, _same(q)), lambda e: e["positions"]))
    return F.filter(found, lambda p: p["weight"].isin(*q.weights)) if q.weights else found


def _positions(vector: Column, q: Query) -> Column:
    """Positions at which a word or phrase ends."""
    if q.kind == "word":
        return F.coalesce(F.transform(_places(vector, q), lambda p: p["at"]), F.array().cast("array<int>"))
    if q.kind == "<>":
        a, b = _positions(vector, q.parts[0]), _positions(vector, q.parts[1])
        return F.array_intersect(b, F.transform(a, lambda x: x + q.distance))
    if q.kind == "|":
        return F.array_union(_positions(vector, q.parts[0]), _positions(vector, q.parts[1]))
    raise ValueError("only words, alternatives and phrases stand inside a phrase")


def matches(vector: Column, q: Query | None) -> Column:
    """vector @@ q."""
    if q is None:
        return F.lit(False)
    if q.kind == "word":
        return F.size(_places(vector, q)) > 0 if q.weights else F.exists(vector, _same(q))
    if q.kind == "!":
        return ~matches(vector, q.parts[0])
    if q.kind == "<>":
        return F.size(_positions(vector, q)) > 0
    a, b = (matches(vector, p) for p in q.parts)
    return a & b if q.kind == "&" else a | b


def matches_text(text: Column, q: Query | None, config: str = "english") -> Column:
    """to_tsvector(text) @@ q without a vector: words are looked for as they stand, phrases in the places they leave."""
    if q is None:
        return F.lit(False)
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    own = words if config == "simple" else F.transform(words, lambda w: lexeme(w, config))

    def ends(p: Query) -> Column:
        if p.kind == "word":
            same = (lambda w: w.startswith(p.word)) if p.prefix else (lambda w: w == p.word)
            return F.filter(F.transform(own, lambda w, i: F.when(same(w), i)), lambda i: i.isNotNull())
        if p.kind == "<>":
            return F.array_intersect(ends(p.parts[1]), F.transform(ends(p.parts[0]), lambda i: i + p.distance))
        if p.kind == "|":
            return F.array_union(*(ends(x) for x in p.parts))
        raise ValueError("only words, alternatives and phrases stand inside a phrase")

    def hit(p: Query) -> Column:
        if p.kind == "word":
            if p.weights and "D" not in p.weights:
                return F.lit(False)
            return F.exists(own, lambda w: w.startswith(p.word)) if p.prefix else F.array_contains(own, p.word)
        if p.kind == "!":
            return ~hit(p.parts[0])
        if p.kind == "<>":
            return F.size(ends(p)) > 0
        a, b = (hit(x) for x in p.parts)
        return a & b if p.kind == "&" else a | b

    return F.when(text.isNotNull(), hit(q))


def _weight(p: Column, weights: Sequence[float]) -> Column:
    out = F.lit(float(weights[0]))
    for name, value in zip("CBA", weights[1:], strict=True):
        out = F.when(p["weight"] == name, F.lit(float(value))).otherwise(out)
    return out


def _frequency(vector: Column, words: list[Query], weights: Sequence[float]) -> Column:
    """Of each word the heaviest position counts whole and the others by the square of their place; the mean over words."""

    def of(q: Query) -> Column:
        own = F.transform(_places(vector, q), lambda p: _weight(p, weights))

        def total(w: Column) -> Column:
            falling = F.aggregate(F.transform(w, lambda x, i: x / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, x: a + x)
            top = F.array_max(w)
            place = F.array_position(w, top).cast("double")
            return F.when(F.size(w) > 0, (falling + top - top / (place * place)) / 1.64493406685).otherwise(0.0)

        return _bound(own, total)

    out = of(words[0])
    for q in words[1:]:
        out = out + of(q)
    return out / len(words)


def _pairs(a: Column, b: Column, weights: Sequence[float]) -> Column:
    """How far each position of a stands from each of b, and the product of their weights."""
    one = lambda x: F.transform(b, lambda y: F.struct(F.abs(x["at"] - y["at"]).alias("far"), (_weight(x, weights) * _weight(y, weights)).alias("w")))
    return F.flatten(F.transform(a, one))


def _closeness(vector: Column, words: list[Query], weights: Sequence[float]) -> Column:
    """Pairs of positions of different words, each the closer the better, as independent chances."""
    miss = F.lit(1.0)
    for i, a in enumerate(words):
        for b in words[:i]:
            each = _pairs(_places(vector, a), _places(vector, b), weights)
            apart = F.filter(each, lambda p: p["far"] > 0)
            near = lambda p: F.when(p["far"] > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(p["far"] / 1.5 - 2.0)))
            miss = miss * F.aggregate(apart, F.lit(1.0), lambda m, p: m * (1.0 - F.sqrt(p["w"] * near(p))))
    return F.lit(1.0) - miss


def rank(vector: Column, q: Query, weights: Sequence[float] = WEIGHTS) -> Column:
    """ts_rank(): by closeness where the query asks for several words at once, else by frequency.

    Position lists are compared in pairs, so the cost of the first grows with their product.
    """
    words = list({str(w): w for w in q.leaves()}.values())

    def of(v: Column) -> Column:
        often = _frequency(v, words, weights)
        if q.kind not in ("&", "<>") or len(words) < 2:
            return often
        close = _closeness(v, words, weights)
        return F.when(close > 0, close).otherwise(often)

    return _bound(vector, of)


def headline(text: Column, q: Query, start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with the query's words marked (words that begin with a lexeme of the query and end there or in a common ending)."""
    endings = {str(w): re.escape(w.word) + (r"\w*" if w.prefix else "(?:s|ed|ing|es)?") for w in q.leaves()}
    alternatives = "|".join(sorted(endings.values(), key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)\b((?:{alternatives}))\b", f"{start}$1{stop}")


def ts_stat(df: DataFrame, vector: str) -> DataFrame:
    """word, ndoc (vectors that have it) and nentry (its places in all of them)."""
    each = df.select(F.explode(vector).alias("e")).select(F.col("e.lexeme").alias("word"), F.size("e.positions").alias("n"))
    return each.groupBy("word").agg(F.count("*").alias("ndoc"), F.sum(F.greatest("n", F.lit(1))).alias("nentry"))


def ts_rewrite(q: Query | None, target: Query, substitute: Query | None) -> Query | None:
    """q with each part that equals target replaced; without a substitute the part goes."""
    if q is None or str(q) == str(target):
        return q and substitute
    if q.kind == "word":
        return q
    parts = [ts_rewrite(p, target, substitute) for p in q.parts]
    if q.kind == "!":
        return Query("!", parts[0]) if parts[0] else None
    left = [p for p in parts if p]
    return Query(q.kind, *left, distance=q.distance) if len(left) == 2 else left[0] if left else None


def querytree(q: Query | None) -> str:
    """The part of a query that an index can look for: T if that is nothing."""

    def plain(p: Query) -> Query | None:
        if p.kind == "word":
            return p
        if p.kind == "!":
            return None
        a, b = (plain(x) for x in p.parts)
        if p.kind == "|":
            return Query("|", a, b) if a and b else None
        return Query(p.kind, a, b, distance=p.distance) if a and b else a or b

    found = q and plain(q)
    return "" if q is None else str(found) if found else "T"


def dict_int(word: Column, most: int = 6, reject: bool = False) -> Column:
    """A dictionary of integers: digits past `most` are cut off, or the word is a stop word."""
    digits = F.regexp_replace(word, r"^[+-]", "")
    kept = F.filter(F.array(word), lambda w: F.length(digits) <= most) if reject else F.array(F.when(F.length(digits) > most, F.substring(word, 1, most)).otherwise(word))
    return F.when(word.rlike(r"^[+-]?\d+$"), kept)


def dict_xsyn(word: Column, synonyms: dict[str, Sequence[str]], keep: bool = True) -> Column:
    """A dictionary of synonyms: a word's, with itself before them if asked for; null for one that it doesn't know."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k.lower()), F.array(*map(F.lit, [k.lower()] * keep + [s.lower() for s in v])))))
    return F.try_element_at(table, F.lower(word))
