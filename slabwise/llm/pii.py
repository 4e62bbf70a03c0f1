"""Personal data, and information-theoretic sanitisation of what reveals it. DataFrame functions only.

Pattern kinds are found first. Every distinct value is a protected entity; terms near it are counted with it in
distinct contexts, and terms of its documents in distinct ones; corpus counts of all terms give how much an entity
becomes likelier once the term is seen and what chance would give, and terms past the disclosure thresholds are marked wherever they occur, to be generalised or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import lower_ascii, release, written

#: Kinds in report order; the last is what the co-occurrence estimate adds.
KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
#: Flagged terms that are broadcast, at most; with more, the words are shuffled instead.
BROADCAST_TERMS = 200_000

_LOCAL = r"A-Za-z0-9._%+\x01-"
#: Patterns over prepared text. Possessive classes without groups keep the matcher iterative and linear: a dot that no
#: domain can hold is \x01 there, a separator inside a number is \x03.
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x03]{12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD_END = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]++"
_SPANS = "array<struct<start:int,end:int,found:string>>"


def _prepared(kind: str, t: Column) -> Column:
    if kind == "email":
        return F.regexp_replace(F.translate(t, "\x01", "\x02"), r"\.(?![A-Za-z0-9-])", "\x01")
    if kind == "card":
        return F.regexp_replace(F.translate(t, "\x03", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x03")
    return t


def _likely(kind: str, t: Column) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return t.contains("@")
    if kind == "phone":
        return t.contains("+")
    return t.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][0-9\x20-]{12}")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _located(t: Column, pattern: Column) -> Column:
    """Matches with their places in code points: what lies between matches gives the places.

    Appending to an array copies it, so places are added up in stretches of about the square root of the number of
    matches, and the stretches put together: the work grows with the power 1.5 of the matches of one text.
    """
    none = F.array().cast(_SPANS)
    pairs = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, pattern, F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), m.alias("found")))

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.gap
        end = start + x.len
        return F.struct(end.alias("at"), F.array_append(acc.out, F.struct(start.alias("start"), end.alias("end"), x.found.alias("found"))).alias("out"))

    def placed(parts: Column) -> Column:
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x.gap + x.len))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        each = F.zip_with(parts, begins, lambda part, at: F.when(part.isNotNull(), F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc.out)).otherwise(none))
        return F.flatten(each)

    def cut(hits: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(hits))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(hits), size), lambda i: F.slice(hits, i, size))

    return _let(F.filter(pairs, lambda x: x.found.isNotNull()), lambda hits: F.when(F.size(hits) > 0, _let(cut(hits), placed)).otherwise(none))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _holds(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    low, high = (13, 19) if kind == "card" else (9, 15)
    sized = F.length(digits).between(low, high)
    return F.when(sized, _luhn(digits)).otherwise(False) if kind == "card" else sized


def _base_kind(kind: str, t: Column) -> Column:
    hits = F.when(_likely(kind, t), _located(_prepared(kind, t), F.lit(_PATTERNS[kind]))).otherwise(F.array().cast(_SPANS))
    value = (lambda c: lower_ascii(c)) if kind in ("email", "ip") else (lambda c: F.regexp_replace(c, "[^0-9]", ""))
    good = F.filter(hits, lambda x: _holds(kind, x.found))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end"), value(x.found).alias("value")))


def find_base(text: Column) -> Column:
    """array<(kind, start, end, value)> of the pattern kinds by kind, then start; ends exclusive, in code points."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*(_base_kind(kind, t) for kind in BASE))


def _words(c: Column) -> Column:
    return F.split(lower_ascii(c), _WORD_END)


def _contexts(t: Column, base: Column, reach: int, words: int) -> Column:
    """For each base span its entity and the terms near it: the last words before and the first after, whole ones.

    Texts are cut into stretches first, as a substring is found by counting characters from the beginning.
    """
    size = max(512, reach)

    def window(parts: Column, at: Column, n: Column) -> Column:
        """``n`` code points, ``reach`` at most, from place ``at`` on."""
        i = F.floor(at / size).cast("int")
        two = F.concat(F.coalesce(F.get(parts, i), F.lit("")), F.coalesce(F.get(parts, i + 1), F.lit("")))
        return F.substring(two, at - i * size + 1, n)

    def near(parts: Column, x: Column) -> Column:
        before = window(parts, F.greatest(x.start - reach, F.lit(0)), F.least(x.start, F.lit(reach)))
        after = window(parts, x.end, F.lit(reach))
        left, right = _words(F.concat(F.lit(" "), before)), _words(F.concat(after, F.lit(" ")))
        cut = F.concat(F.slice(F.reverse(left), 1, words), F.slice(right, 1, words))
        return F.struct(F.xxhash64(x.kind, x.value).alias("entity"), F.array_distinct(F.filter(cut, lambda w: F.length(w) >= 3)).alias("terms"), F.xxhash64(before, after).alias("context"))

    return _let(F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)), lambda parts: F.transform(base, lambda x: near(parts, x)))


def _surprise(n: Column, mean: Column) -> Column:
    """Bits of the Chernoff bound on ``n`` or more events where ``mean`` are expected by chance; 0 if not more."""
    return F.when(n > mean, (n * F.log(n / mean) - n + mean) / F.log(F.lit(2.0))).otherwise(0.0)


def revealing_terms(docs: DataFrame, found: DataFrame, *, text_col: str, max_chance: float, min_share: float, min_bits: float) -> DataFrame | None:
    """(term, bits): terms of which ``min_share`` or more of the uses are near one entity, or in its documents, which
    make the entity ``min_bits`` likelier (smoothed), and which meet it in more distinct contexts, or documents, than
    chance gives with probability ``max_chance`` over all pairs seen. None without entities."""
    each = found.select("ver", F.explode("contexts").alias("c"))
    held = each.groupBy("c.entity", "ver").agg(F.count(F.lit(1)).alias("uses"), F.sum(F.size("c.terms")).alias("slots"))
    place = [F.bit_xor(F.xxhash64(F.lit(i), "ver")) for i in (1, 2)]  # tells sets of documents apart
    entities = held.groupBy("entity").agg(F.sum("uses").alias("uses"), F.sum("slots").alias("slots"), F.count(F.lit(1)).alias("texts"), F.xxhash64(F.count(F.lit(1)), *place).alias("class"))
    entities = written(entities, "entities")
    if entities.isEmpty():
        release(entities)
        return None
    near = each.select("c.entity", F.explode("c.terms").alias("term"), F.col("c.context").alias("at")).groupBy("entity", "term", "at").agg(F.count(F.lit(1)).alias("n"))
    near = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("n")).withColumn("members", F.lit(1).cast("long"))
    near = near.join(entities.select("entity", "uses", "slots", "texts"), "entity").select(F.lit(1).alias("kind"), "term", "times", "n", "members", "uses", "slots", "texts")
    # Entities of the same documents meet the same terms there, so they are one: a text with many entities and many
    # terms makes no row for each pair. The one used least tells most.
    classes = entities.groupBy("class").agg(F.count(F.lit(1)).alias("members"), F.min("uses").alias("uses"), F.first("texts").alias("texts"))
    within = held.select("entity", "ver").join(entities.select("entity", "class"), "entity").select("class", "ver").distinct()
    said = found.select("ver", F.explode("said").alias("term")).groupBy("ver", "term").agg(F.count(F.lit(1)).alias("n"))
    whole = said.join(within, "ver").groupBy("class", "term").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("n"))
    whole = whole.join(classes, "class").select(F.lit(0).alias("kind"), "term", "times", "n", "members", "uses", F.lit(0).cast("long").alias("slots"), "texts")
    pairs = written(near.unionByName(whole), "pairs")
    tests = {r[0]: r[1] for r in pairs.groupBy("kind").agg(F.sum("members")).collect()}
    uses = docs.select(F.explode(_words(F.col(text_col))).alias("term")).where(F.length("term") >= 3).groupBy("term").agg(F.count(F.lit(1)).alias("all"))
    uses = written(uses, "uses")
    words, texts = uses.agg(F.sum("all")).first()[0], docs.count()
    total = entities.agg(F.sum("uses")).first()[0]
    likely = F.greatest("all", "n")
    counted = pairs.join(uses, "term")
    mean = F.when(F.col("kind") == 1, likely * F.col("slots") / F.lit(float(words or 1))).otherwise(likely * F.col("texts") / F.lit(float(texts or 1)))
    needed = F.when(F.col("kind") == 1, F.lit(float(tests.get(1, 1)))).otherwise(F.lit(float(tests.get(0, 1)))) / max_chance
    bits = F.log2((F.col("n") + 0.5) / (likely + 1.0) / ((F.col("uses") + 0.5) / F.lit(total + 1.0)))
    good = (F.col("n") / likely >= min_share) & (bits >= min_bits) & (_surprise(F.col("times").cast("double"), mean) >= F.log2(needed))
    terms = written(counted.where(good).groupBy("term").agg(F.max(bits).alias("bits")), "terms")
    release(entities, pairs, uses)
    return terms


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", reach: int = 64, words: int = 4, max_chance: float = 0.05, min_share: float = 0.5, min_bits: float = 3.0) -> DataFrame:
    """(id, spans): one row per input row; spans are array<(kind, start, end)> by kind, then start.

    Null texts count as empty and have no spans. Rows that repeat an id each get their own text's spans, a null id
    too. Columns besides the two named are not read; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("ver"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = own.select("id", "ver", "text", find_base(F.col("text")).alias("hits")).where(F.size("hits") > 0)
    place = lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.end.alias("end"))
    found = written(base.select("id", "ver", F.transform("hits", place).alias("base"), _contexts(F.col("text"), F.col("hits"), reach, words).alias("contexts"), F.filter(_words(F.col("text")), lambda w: F.length(w) >= 3).alias("said")), "pii")
    once = lambda df, c: df.groupBy("id", "ver").agg(F.first(c).alias(c))
    out = _left(own.select("id", "ver"), once(found, "base"))
    spans = F.coalesce("base", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    terms = revealing_terms(own, found, text_col="text", max_chance=max_chance, min_share=min_share, min_bits=min_bits)
    if terms is not None:
        few = terms.count() <= BROADCAST_TERMS
        word = own.select("id", "ver", F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
        known = F.broadcast(terms) if few else terms
        sets = written(word.join(known, "term", "left_semi").select("id", "ver").distinct(), "marked")
        every = _left(sets, own).select("id", "ver", F.explode(_located(lower_ascii(F.col("text")), F.lit(_WORD))).alias("x"))
        marks = every.select("id", "ver", "x.*").join(known, F.col("found") == F.col("term"), "left_semi")
        at = F.transform(F.array_sort(F.collect_set(F.struct("start", "end"))), lambda x: F.struct(F.lit("term").alias("kind"), x.start.alias("start"), x.end.alias("end")))
        out = _left(out, marks.groupBy("id", "ver").agg(at.alias("more")))
        spans = F.concat(spans, F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    out = written(out.select(F.col("id").alias(id_col), spans.alias("spans")), "pii-spans")
    release(found, *([terms, sets] if terms is not None else []))
    return out


def _left(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left join on (id, ver) in which null ids meet."""
    b = b.withColumnRenamed("id", "__id").withColumnRenamed("ver", "__ver")
    return a.join(b, F.col("id").eqNullSafe(F.col("__id")) & (F.col("ver") == F.col("__ver")), "left").drop("__id", "__ver")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap an earlier one are absorbed."""
    t = F.coalesce(text, F.lit(""))
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))))

    def step(acc: Column, x: Column) -> Column:
        kept = F.concat(acc.out, F.substring(t, acc.at + 1, x.start - acc.at), F.lit("["), F.upper(x.kind), F.lit("]"))
        inside = x.start < acc.at
        return F.struct(F.greatest(acc.at, x.end).alias("at"), F.when(inside, acc.out).otherwise(kept).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(order, zero, step, lambda acc: F.concat(acc.out, F.substring(t, acc.at + 1, F.length(t))))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    return found.select(id_col, *(count(k) for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
