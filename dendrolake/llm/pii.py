"""Personal data: patterns with checks, and information-theoretic sanitisation of the terms that come with them.
DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashSet, let, saved, unused

KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

# The patterns with possessive repeats, and starts only where a run of their first characters starts (or where the
# last match ended): the same matches without quadratic search in long runs.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be looked for, and for any of them: most texts hold none of these characters.
NEEDS_ANY = "[0-9@]"
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Distinct texts in which a term and an entity must meet before the corpus says anything about them.
SUPPORT = 2
#: Bits of the set of hashed terms that each task has, to pass over words that cannot be one of them: so many for a term, so
#: that few of a text's hundreds of words pass by chance, within bounds (2 MB at most) that do not grow with the corpus.
TERM_BITS, LEAST_BITS, MOST_BITS = 128, 1 << 20, 1 << 24
#: Matches and characters of a block: places and texts are worked out block by block, so that no step copies a whole.
_MATCHES, _CHARACTERS = 64, 4096
#: Share of an entity's information content that a term may disclose.
DISCLOSURE = 0.9


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(i: Column) -> Column:
        n = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 0, twice).otherwise(n)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), doubled), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(m))
    return n.between(10, 15)


def _located(text: Column, pattern: Column) -> Column:
    """Array of (start, end, value) of all matches, in code points: sums of lengths within blocks of matches and over
    the blocks before."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    zero = F.lit(0).cast("long")

    def long(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: a + x["g"] + x["n"])

    def placed(found: Column, sums: Column, b: Column) -> Column:
        before = F.aggregate(F.slice(sums, F.lit(1), b), zero, lambda a, x: a + x)

        def at(start: Column, own: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                return let(start + long(F.slice(own, F.lit(1), i)) + x["g"], lambda s: F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v")))

            return F.transform(own, one)

        return let(before, lambda start: let(F.slice(found, b * _MATCHES + 1, F.lit(_MATCHES)), lambda own: at(start, own)))

    def blocks(found: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(found) / _MATCHES).cast("int") - 1, F.lit(0)))
        sums = F.transform(numbers, lambda b: long(F.slice(found, b * _MATCHES + 1, F.lit(_MATCHES))))
        return let(sums, lambda own: F.flatten(F.transform(numbers, lambda b: placed(found, own, b))))

    def zipped(hits: Column, gaps: Column) -> Column:
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
        size = lambda x: F.length(x).cast("long")
        return F.transform(pairs, lambda x: F.struct(size(x["gap"]).alias("g"), size(x["hit"]).alias("n"), x["hit"].alias("v")))

    return let(let(hits, lambda h: let(gaps, lambda g: zipped(h, g))), blocks)


SPAN = "array<struct<s:bigint,k:int,e:bigint,v:string>>"


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) of the base kinds, by start, then kind as listed."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(_located(text, F.lit(PATTERNS[kind])), lambda x: _valid(kind, x["v"]))
        spans = F.transform(good, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPAN))

    none = F.array().cast(SPAN)
    return F.when(text.rlike(NEEDS_ANY), F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))).otherwise(none)


#: Stands for each character of a base span; a run of letters and digits beside it is no whole word.
_MASK = "\ue000"
_NO_WORD = rf"(?<![\p{{L}}\p{{N}}{_MASK}])", rf"(?![\p{{L}}\p{{N}}{_MASK}])"


def _rewritten(text: Column, spans: Column, cover) -> Column:
    """The text with each span's characters replaced by what ``cover(span, fresh, width)`` gives: ``width`` is how many of
    its characters stand in the block at hand and no earlier span covers, ``fresh`` whether it starts there uncovered."""

    def block(b: Column) -> Column:
        low = b * _CHARACTERS
        own = F.filter(spans, lambda x: (x["s"] < low + _CHARACTERS) & (x["e"] > low))

        def joined(part: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                start = F.greatest(acc["pos"], x["s"] - low)
                end = F.least(F.lit(_CHARACTERS).cast("long"), F.greatest(acc["pos"], x["e"] - low))
                gap = F.substring(part, acc["pos"].cast("int") + 1, (start - acc["pos"]).cast("int"))
                fresh = x["s"] - low >= acc["pos"]
                return F.struct(end.alias("pos"), F.concat(acc["out"], gap, cover(x, fresh, (end - start).cast("int"))).alias("out"))

            first = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
            return F.aggregate(own, first, step, lambda a: F.concat(a["out"], F.substring(part, a["pos"].cast("int") + 1, F.lit(_CHARACTERS))))

        return let(F.substring(text, low + 1, F.lit(_CHARACTERS)), joined)

    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / _CHARACTERS).cast("int") - 1, F.lit(0)))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(blocks, block), ""))


def _masked(text: Column, spans: Column) -> Column:
    """The text with its length kept and its base spans blotted out."""
    return _rewritten(F.translate(text, _MASK, " "), spans, lambda x, fresh, width: F.repeat(F.lit(_MASK), width))


def _terms(text: Column, spans: Column) -> Column:
    """Distinct terms, in lower case, of a text outside its base spans."""
    found = F.regexp_extract_all(_masked(text, spans), F.lit(rf"{_NO_WORD[0]}\p{{L}}[\p{{L}}\p{{N}}]{{2,}}+{_NO_WORD[1]}"), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


_WORDS = r"[^\p{L}\p{N}]+"


def _term_set(hashes: DataFrame) -> HashSet:
    """The set of the hashes (column ``h``) of a saved table, by its number of rows."""
    wanted = max(1, hashes.count() * TERM_BITS)
    return HashSet(hashes.select("h"), min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length())))


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``h, t``: the terms, in lower case, that disclose a protected value, and their hashes.

    A term discloses a value when the two meet in ``support`` distinct texts or more and their pointwise mutual
    information, log2(N n(v,t) / (n(v) n(t))) over whole documents, reaches ``disclosure`` times the value's information
    content log2(N / n(v)). N, n(v), n(t) and n(v,t) count documents, all of them and copies too; a term is in a document
    if it stands there outside all base spans, for n(t) as for n(v,t). A value or a term may be in any share of all
    documents: counts are summed before they are shuffled, and no join is on a value that carries texts. Values that are
    in the same texts have the same counts with every term, so they are counted as one: ten thousand addresses of one
    list cost as much as one of them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(text.alias("text"), F.xxhash64(text).alias("text_key"))

    def held_by(base: Column) -> Column:
        values = F.array_distinct(F.transform(base, lambda x: F.lower(x["v"])))
        return F.when(F.size(base) > 0, F.array(F.struct(values.alias("vs"), _terms(F.col("text"), base).alias("ts"))))

    # a row for each text that holds a value; exploded, so that no filter works the spans out a second time
    marked = source.select("text_key", F.explode(let(base_spans(F.col("text")), held_by)).alias("x")).select("text_key", "x.vs", "x.ts")
    texts = saved(marked.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("vs").alias("vs"), F.first("ts").alias("ts")), "texts")
    held = texts.select("text_key", "copies", F.explode("vs").alias("v"))
    # the texts that a value is in, told apart by two hashes of them all and their number
    place = [F.bit_xor(F.xxhash64("text_key", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    n_value = held.groupBy("v").agg(F.sum("copies").alias("n_v"), F.count("*").alias("texts"), *place).where(F.col("texts") >= support)
    alike = F.struct("x1", "x2", "texts", "n_v")
    with_value = held.drop("copies").join(n_value.hint("merge"), "v").groupBy("text_key").agg(F.collect_set(alike).alias("x"))
    met = texts.select("text_key", "copies", "ts").join(with_value.hint("merge"), "text_key").select("copies", F.explode("x").alias("x"), "ts")
    pairs = met.select("copies", "x", F.explode("ts").alias("t")).groupBy("x", "t")
    pairs = pairs.agg(F.sum("copies").alias("n_vt"), F.count("*").alias("places")).where(F.col("places") >= support)
    pairs = saved(pairs.select("x.n_v", "t", "n_vt", F.xxhash64("t").alias("h")), "pairs")

    known = _term_set(pairs)
    words = F.array_distinct(F.transform(F.split(F.col("text"), _WORDS), lambda w: F.xxhash64(F.lower(w))))
    plain = source.where(F.size(base_spans(F.col("text"))) == 0).select(F.explode(words).alias("h"), F.lit(1).alias("n"))
    own = F.transform("ts", lambda t: F.xxhash64(t))  # of a text with values: outside them
    own = texts.select(F.explode(own).alias("h"), F.col("copies").cast("int").alias("n"))
    n_term = plain.union(own).where(known.may_have(F.col("h"))).groupBy("h").agg(F.sum("n").alias("n_t"))
    n_all = source.agg(F.count("*").alias("n"))
    scored = pairs.join(n_term.hint("merge"), "h").crossJoin(F.broadcast(n_all))
    pmi = F.log2(F.col("n") * F.col("n_vt") / (F.col("n_v") * F.col("n_t")))
    return saved(scored.where(pmi >= disclosure * F.log2(F.col("n") / F.col("n_v"))).where("n > n_v").select("h", "t").distinct(), "risky")


def _flagged(docs: DataFrame, text: Column, risky: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the distinct words of a text that may be disclosing terms, sorted."""
    known, words = _term_set(risky), F.array_distinct(F.split(text, _WORDS))
    (bits,) = unused(docs, "bits")
    found = let(F.col(bits), lambda own: F.filter(words, lambda w: known.may_have(F.xxhash64(F.lower(w)), own)))
    return docs.withColumn(bits, known.words).withColumn(name, F.sort_array(found)).drop(bits)


def _term_spans(texts: DataFrame, risky: DataFrame) -> DataFrame:
    """``text_key, check, added``: places of disclosing terms in each distinct text of ``text_key, check, text, words`` (its
    words that may be some). Texts with the same such words look them up once."""
    texts = saved(texts.dropDuplicates(["text_key", "check"]).withColumn("set", F.xxhash64("words")), "flagged")
    known = texts.select("set", "words").dropDuplicates(["set"]).select("set", F.explode("words").alias("w")).withColumn("h", F.xxhash64(F.lower("w")))
    forms = known.join(risky.hint("merge"), "h").where(F.lower("w") == F.col("t")).groupBy("set").agg(F.sort_array(F.collect_set("w")).alias("forms"))
    forms = saved(forms, "forms")  # so that a set that very many texts have can be split where they are joined
    pattern = F.concat(F.lit(_NO_WORD[0] + "(?:"), F.array_join("forms", "|"), F.lit(")" + _NO_WORD[1]))
    located = texts.join(forms.hint("merge"), "set").withColumn("base", base_spans(F.col("text")))
    located = located.withColumn("at", _located(_masked(F.col("text"), F.col("base")), pattern))
    as_spans = F.transform("at", lambda w: F.struct(w["s"].alias("s"), F.lit(len(KINDS)).alias("k"), w["e"].alias("e"), F.lower(w["v"]).alias("v")))
    return saved(located.select("text_key", "check", as_spans.alias("added")), "terms")


def _keys(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(text).alias("text_key"), F.hash(text).alias("check")]


def _with_terms(base: Column) -> Column:
    return F.sort_array(F.concat(base, F.coalesce("added", F.array().cast(SPAN))))


def find_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = SUPPORT,
    disclosure: float = DISCLOSURE,
) -> DataFrame:
    """``id_col, text_key`` (hash of the text) and ``spans`` (array of s, k, e, v) of every row.

    k counts the base kinds (email, ip, card, phone); 4 is a term: each place, in whatever document, of a word of
    ``disclosing_terms``. Term spans overlap no base span.

    A null text counts as empty; null ids keep their rows. Repeated rows each get their row. Very long texts and very
    many matches are worked out in blocks. An empty table gives no rows. Other columns, of whatever name, are not used.
    """
    risky = disclosing_terms(docs, text_col, support, disclosure)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), *_keys(text))
    flagged = _flagged(source, F.col("text"), risky, "words").select("text_key", "check", "text", "words").where(F.size("words") > 0)
    added = _term_spans(flagged, risky)
    marked = saved(source.select("id", "text_key", "check", base_spans(F.col("text")).alias("base")), "spans")
    joined = marked.join(added.hint("merge"), ["text_key", "check"], "left")
    return joined.select(F.col("id").alias(id_col), "text_key", _with_terms(F.col("base")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in [*KINDS, TERM]))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def sanitise(docs: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with each base span replaced by its kind in brackets and each disclosing term by ``[term]``; of spans that
    overlap the first is replaced. Rows, their other columns and null texts stay as they are, repeated ones too.

    Only texts with words that may be disclosing terms are shuffled; all others are rewritten where they are. Which they
    are is found in one pass, which writes the others' new texts as well, so that no text is searched for words again.
    """
    risky = disclosing_terms(docs, text_col, support, disclosure)
    text = F.col(text_col).cast("string")
    words, key, check = unused(docs, "words", "key", "check")
    whole = _flagged(docs, text, risky, words)
    names = F.array(*(F.lit(f"[{k}]") for k in [*KINDS, TERM]))

    def clean(spans: Column) -> Column:
        return F.when(text.isNotNull(), let(spans, lambda x: _rewritten(text, x, lambda y, fresh, width: F.when(fresh, F.get(names, y["k"])).otherwise(""))))

    new = F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, clean(base_spans(text))).otherwise(text)
    void = [c for c, kind in docs.dtypes if kind == "void" and c != text_col]  # cannot be written
    whole = saved(whole.withColumn(text_col, new).drop(*void), "cleaned").withColumns({c: F.lit(None) for c in void})
    plain = whole.where(F.coalesce(F.size(words), F.lit(0)) <= 0)
    odd = whole.where(F.size(words) > 0).withColumns({key: F.xxhash64(text), check: F.hash(text)})
    added = _term_spans(odd.select(F.col(key).alias("text_key"), F.col(check).alias("check"), text.alias("text"), F.col(words).alias("words")), risky)
    found = added.select(F.col("text_key").alias(key), F.col("check").alias(check), F.struct("added").alias(words))
    joined = odd.drop(words).join(found.hint("merge"), [key, check], "left")
    more = F.coalesce(F.col(words)["added"], F.array().cast(SPAN))
    joined = joined.withColumn(text_col, clean(F.sort_array(F.concat(base_spans(text), more))))
    return plain.select(*_quoted(docs)).unionByName(joined.select(*_quoted(docs)))


def _quoted(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]
