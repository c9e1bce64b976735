"""Names of entities in lines and in claims: where they stand, and which rows a misspelt one means.

Likeness is that of ``functions.likeness``, of lower-case text. A name in a line is found by a partial ratio of 95 at
least, a claim's name by a weighted ratio of 85 at least."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import lexicons as lx
from factledger.functions.arrays import let, running, spans, total
from factledger.functions.likeness import best_window, masks, weighted_ratio
from factledger.sources.scratch import stored

LINE = ["note_id", "line_idx"]
LEAST_IN_LINE, LEAST_IN_CLAIM, WITHIN, MOST_ROWS = 95, 85, 2, 5
LEAST_NEAR, GRAMS = 8, (5, 7, 9, 12)  # letters of a name that may be nearly written, and of the runs by which it meets lines
HEADS = (2, 4, 8, 16, 32)  # letters of the beginnings by which names written otherwise meet lines
MARKS = 3  # between the words of a name
WORD, BEYOND = "[a-z0-9]+", r"[\p{L}\p{N}&&[^\x00-\x7F]]+"


def dictionary(tables: DataFrame) -> DataFrame:
    """``table_id``, ``entity``, ``kind``, ``form`` (lower case) and ``words``: each name (kind 0), and each alias of one (1)."""
    alias = F.create_map(*[F.lit(x) for pair in [*lx.ALIASES.items(), ("us", "USA")] for x in pair])
    own = tables.select("table_id", F.col("Entity").alias("entity")).distinct()
    other = F.transform(F.map_keys(F.map_filter(alias, lambda _, v: v == F.col("entity"))), lambda a: F.struct(F.lit(1).alias("kind"), a.alias("form")))
    forms = own.select("*", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.lower("entity").alias("form"))), other)).alias("x")).select("table_id", "entity", "x.*")
    return forms.where("form <> ''").withColumn("words", spans(F.col("form"), WORD))


def postings(forms: DataFrame) -> DataFrame:
    """The forms under the one word of each that the fewest forms of its table have: ``word`` and ``offset`` (where it
    stands in the form). Words beyond ASCII count only where there are no others."""
    key = lambda w: F.struct(w["raw"].alias("word"), w["start"].alias("offset"))
    each = F.when(F.size("words") > 0, F.transform("words", key)).otherwise(F.transform(spans(F.col("form"), BEYOND), key))
    keys = forms.select("table_id", "entity", "kind", "form", F.explode(each).alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("table_id", "key.word")))
    return keys.groupBy("table_id", "entity", "kind", "form").agg(F.min_by("key", F.struct("n", "key.offset")).alias("key")).select("table_id", "entity", "kind", "form", "key.*")


def run_postings(forms: DataFrame) -> DataFrame:
    """Names of several words under the beginning of their words written together: ``head``. ``steps``: how many letters
    stand before each word."""
    joined = F.array_join("words.raw", "")
    size = F.char_length(joined)
    head = F.coalesce(*[F.when(size >= n, F.substring(joined, 1, n)) for n in reversed(HEADS)])
    steps = F.transform(F.col("words"), lambda _, i: total(F.transform(F.slice("words", F.lit(1), i), lambda w: F.char_length(w["raw"]))))
    return forms.where((F.col("kind") == 0) & (F.size("words") >= 2)).select("table_id", "entity", joined.alias("form"), steps.alias("steps"), head.alias("head"))


def gram_postings(forms: DataFrame) -> DataFrame:
    """Long names under a few runs of letters (``GRAMS``), of which a stretch that is like enough has at least one unchanged:
    a name of n letters is cut into one more piece than letters may be taken out or put in, and of each piece the run that
    the fewest names have is taken. ``gram``, ``offset``, ``slack``."""
    n = F.char_length("form")
    slack = F.floor(n * (2 * (100 - LEAST_IN_LINE)) / 100).cast("int")
    long = forms.where((F.col("kind") == 0) & (n >= LEAST_NEAR)).select("table_id", "entity", "form", slack.alias("slack"))
    size = F.floor(n / (F.col("slack") + 1)).cast("int")
    gram = F.coalesce(*[F.when(size >= n, n) for n in reversed(GRAMS)])  # a piece has 5 letters at least
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.col("slack")), lambda p: F.transform(F.sequence(p * size, (p + 1) * size - gram), lambda o: F.struct(p.alias("piece"), o.alias("offset"), F.substring("form", o + 1, gram).alias("gram")))))
    keys = long.select("*", F.explode(cut).alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("table_id", "key.gram")))
    best = keys.groupBy("table_id", "entity", "form", "slack", "key.piece").agg(F.min_by("key", F.struct("n", "key.offset")).alias("key"))
    return best.select("table_id", "entity", "form", "slack", "key.gram", "key.offset")


def entity_spans(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """note_id, line_idx, table_id, entity, start, end of the names that a line holds.

    Whole names, longest first; then aliases ("US" only in capitals); then the same words with up to three other marks
    between them; then names of eight letters or more that a stretch of the line is nearly like. A later kind takes only
    room, and the last two only entities, that the kinds before have left.

    Lines meet names by words: each name stands in an index under its rarest word, and is compared with a line only where
    that word stands in it. Names that are nearly written meet lines by short runs of letters in the same way. A line takes
    part in the joins by its words and their places only, and is then looked at once, with all that it met."""
    low = F.lower("line")
    text = lines.select(*LINE, "table_id", "line", low.alias("low"), spans(low, WORD).alias("t"))
    before = F.coalesce(running(F.transform("t", lambda w: F.char_length(w["raw"]))), F.array().cast("array<int>"))
    token = lambda w, n: F.struct(w["start"].alias("start"), w["end"].alias("end"), w["raw"].alias("raw"), (n - F.char_length(w["raw"])).alias("step"))
    text = stored(text.select("*", F.zip_with("t", before, token).alias("tokens"), F.array_join("t.raw", "").alias("joined")).drop("t"), "words")
    forms = stored(dictionary(tables), "names")

    beyond = F.transform(spans(F.col("low"), BEYOND), lambda w: F.struct(w["raw"].alias("word"), w["start"].alias("place")))
    plain = F.transform("tokens", lambda w: F.struct(w["raw"].alias("word"), w["start"].alias("place")))
    words = text.select(*LINE, "table_id", F.explode(F.concat(plain, beyond)).alias("x")).select(*LINE, "table_id", "x.*")
    whole = words.join(postings(forms), ["table_id", "word"]).select(*LINE, _candidate(F.col("kind"), F.col("place") - F.col("offset")))
    begin = lambda w, i: F.transform(F.array(*map(F.lit, HEADS)), lambda n: F.struct(F.substring("joined", w["step"] + 1, n).alias("head"), i.alias("first")))
    runs = text.select(*LINE, "table_id", F.explode(F.array_distinct(F.flatten(F.transform("tokens", begin)))).alias("x")).select(*LINE, "table_id", "x.*")
    runs = runs.join(run_postings(forms), ["table_id", "head"]).select(*LINE, _candidate(F.lit(2), F.col("first"), F.col("steps")))
    grams = lambda n: F.transform(_grams(F.col("low"), n), lambda g, i: F.struct(i.alias("place"), g.alias("gram")))
    near = text.select(*LINE, "table_id", F.explode(F.concat(*map(grams, GRAMS))).alias("x")).select(*LINE, "table_id", "x.*")
    near = near.join(gram_postings(forms), ["table_id", "gram"]).select(*LINE, _candidate(F.lit(3), F.col("place") - F.col("offset"), F.array("slack"))).distinct()
    each = whole.unionByName(runs).unionByName(near).groupBy(*LINE).agg(F.collect_set("c").alias("met"))
    found = text.join(each, LINE).select(*LINE, "table_id", _resolved().alias("found"))
    return found.select(*LINE, "table_id", F.explode("found").alias("x")).select(*LINE, "table_id", "x.entity", "x.start", "x.end")


def _candidate(kind: Column, start: Column, more: Column | None = None) -> Column:
    """A name that a line met. ``start``: where it would begin (kind 2: the number of its first word in the line); ``more``:
    letters before each word (kind 2), letters that may change (kind 3)."""
    more = F.array().cast("array<int>") if more is None else more
    return F.struct("entity", "form", kind.alias("kind"), start.alias("start"), more.alias("more")).alias("c")


_SPAN = "array<struct<kind:int,longest:int,entity:string,start:int,end:int>>"


def _resolved() -> Column:
    """The names that stand in a line, of those that it met."""
    line, low, tokens, joined, met = map(F.col, ("line", "low", "tokens", "joined", "met"))
    word = lambda at: F.coalesce(F.substring(low, at, F.lit(1)).rlike(r"(?U)\w"), F.lit(False))
    size = lambda c: F.char_length(c["form"])
    span = lambda kind, c, start, end: F.struct(F.lit(kind).alias("kind"), (-size(c) if kind == 0 else F.lit(0)).alias("longest"), c["entity"].alias("entity"), start.alias("start"), end.alias("end"))
    of = lambda kind: F.filter(met, lambda c: c["kind"] == kind)

    def whole(c: Column) -> Column:
        free = ~((c["start"] > 0) & word(c["start"])) & ~word(c["start"] + size(c) + 1)
        capitals = (c["form"] != "us") | (F.substring(line, c["start"] + 1, F.lit(2)) == "US")
        return (c["start"] >= 0) & (F.substring(low, c["start"] + 1, size(c)) == c["form"]) & free & capitals

    def same_words(c: Column) -> Column:
        """The last of the line's words that together are the name's, which part only where it parts; null if they aren't."""
        first = F.get(tokens, c["start"])

        def checked(own: Column) -> Column:
            last = F.get(own, F.size(own) - 1)
            parts = F.forall(F.sequence(F.lit(1), F.size(own) - 1), lambda j: F.array_contains(c["more"], F.get(own, j)["step"] - first["step"]) & (F.get(own, j)["start"] - F.get(own, j - 1)["end"] <= MARKS))
            return F.when((last["step"] + F.char_length(last["raw"]) == first["step"] + size(c)) & ((F.size(own) == 1) | parts), last["end"])

        own = F.filter(F.slice(tokens, c["start"] + 1, F.size(c["more"])), lambda t: t["step"] < first["step"] + size(c))
        return F.when(F.substring(joined, first["step"] + 1, size(c)) == c["form"], let(own, checked))

    written_out = lambda k: F.transform(F.filter(of(k), whole), lambda c: span(k, c, c["start"], c["start"] + F.char_length(c["form"])))
    exact = F.concat(written_out(0), written_out(1))
    ends = F.transform(of(2), lambda c: F.struct(c.alias("c"), same_words(c).alias("end")))
    runs = F.transform(F.filter(ends, lambda x: x["end"].isNotNull()), lambda x: span(2, x["c"], F.get(tokens, x["c"]["start"])["start"], x["end"]))

    def room(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"]) | (x["kind"] >= 2) & (y["kind"] < x["kind"]) & (y["entity"] == x["entity"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    def written(found: Column) -> Column:
        """The best stretch for each name that has not been found; names in order."""
        lost = F.filter(of(3), lambda c: ~F.exists(found, lambda y: y["entity"] == c["entity"]))
        best = F.transform(lost, lambda c: F.struct(c["entity"].alias("entity"), best_window(masks(c["form"]), size(c), low, F.sequence(c["start"] - F.get(c["more"], F.lit(0)), c["start"] + F.get(c["more"], F.lit(0)))).alias("w")))
        good = F.filter(best, lambda x: x["w"]["score"] >= LEAST_IN_LINE)

        def first(good: Column) -> Column:
            top = F.filter(good, lambda x: ~F.exists(good, lambda y: (y["entity"] == x["entity"]) & (F.struct(y["w"]["score"], y["w"]["earlier"]) > F.struct(x["w"]["score"], x["w"]["earlier"]))))
            return F.array_sort(F.array_distinct(F.transform(top, lambda x: F.struct(F.lit(3).alias("kind"), F.lit(0).alias("longest"), x["entity"].alias("entity"), x["w"]["start"].alias("start"), x["w"]["end"].alias("end")))))

        return F.when(F.size(lost) > 0, let(good, first)).otherwise(F.array().cast(_SPAN))

    fixed = lambda m: F.aggregate(m, F.array().cast(_SPAN), room)
    known = fixed(F.array_sort(F.array_distinct(F.concat(exact, runs))))
    return let(known, lambda k: F.aggregate(written(k), k, room))


def _grams(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) >= n, F.transform(F.sequence(F.lit(0), F.char_length(text) - n), lambda i: F.substring(text, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _piece_grams(text: Column, share: float, n: int) -> Column:
    """``piece`` and ``gram`` (n letters, or fewer where a piece is shorter): the text in one more piece than the letters that
    ``share`` of its length lets change."""
    size, slack = F.char_length(text), F.floor(F.char_length(text) * share).cast("int")
    width = F.floor(size / (slack + 1)).cast("int")
    gram = F.least(width, F.lit(n))
    each = lambda p: F.transform(F.sequence(p * width, (p + 1) * width - gram), lambda o: F.struct(p.alias("piece"), F.substring(text, o + 1, gram).alias("gram")))
    return F.when(width > 0, F.flatten(F.transform(F.sequence(F.lit(0), slack), each))).otherwise(F.array().cast("array<struct<piece:int,gram:string>>"))


def like_pairs(asked: DataFrame, own: DataFrame, key: list[str], name: str) -> DataFrame:
    """``key``, ``row``: every row whose name may have a weighted ratio of ``LEAST_IN_CLAIM`` with the one asked for, and few
    others. Two such names share a word; or, as they stand or with their words in order, one of the pieces of the row's name
    stands unchanged in the other (a ratio of 85 leaves at most 0.353 of its letters to change); or one of the pieces of the
    name asked for stands in a longer row's name (a partial ratio of 94 leaves 0.112)."""
    ways = lambda x: F.array(F.struct(F.lit("as is").alias("way"), x.alias("text")), F.struct(F.lit("in order").alias("way"), in_order(x).alias("text")))
    a = asked.select(*key, "table_id", F.explode(ways(F.col(name))).alias("x")).select(*key, "table_id", "x.*")
    b = own.select("table_id", "row", F.explode(ways(F.lower("row"))).alias("x")).select("table_id", "row", "x.*")
    met = lambda left, right, *on: left.join(right, ["table_id", "way", *on]).select(*key, "row")
    word = lambda x: F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")
    by_word = met(a.select(*key, "table_id", "way", word("text")), b.select("table_id", "row", "way", word("text")), "word")
    cut = b.select("table_id", "row", "way", F.explode(_piece_grams(F.col("text"), 0.353, 2)).alias("x")).select("table_id", "row", "way", "x.*")
    rare = cut.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("table_id", "way", "gram"))).groupBy("table_id", "row", "way", "piece").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    held = a.select(*key, "table_id", "way", F.explode(F.array_distinct(F.concat(_grams(F.col("text"), 1), _grams(F.col("text"), 2)))).alias("gram"))
    wanted = a.select(*key, "table_id", "way", F.explode(_piece_grams(F.col("text"), 0.112, 4)).alias("x")).groupBy(*key, "table_id", "way", "x.piece").agg(F.max("x.gram").alias("gram"))
    every = b.select("table_id", "row", "way", F.explode(F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in (1, 2, 3, 4)]))).alias("gram"))
    return by_word.unionByName(met(held, rare, "gram")).unionByName(met(wanted, every, "gram")).distinct()


def in_order(text: Column) -> Column:
    """The words in alphabetical order."""
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def fuzzy_rows(asked: DataFrame, tables: DataFrame, key: list[str], name: str) -> DataFrame:
    """``key``, ``row``, ``score`` of the rows most like a name of no row: within ``WITHIN`` of the best, ``MOST_ROWS`` at
    most."""
    own = tables.select("table_id", F.col("Entity").alias("row")).distinct()
    both = asked.select(*key, name).join(like_pairs(asked, own, key, name), key)
    like = both.select(*key, "row", weighted_ratio(F.col(name), F.lower("row")).alias("score")).where(F.col("score") >= LEAST_IN_CLAIM)
    claim = Window.partitionBy(*key)
    best = like.withColumn("best", F.max("score").over(claim)).where(F.col("score") >= F.col("best") - WITHIN)
    return best.withColumn("k", F.row_number().over(claim.orderBy(F.desc("score"), "row"))).where(F.col("k") <= MOST_ROWS).select(*key, "row", "score")
