"""Operator 10: personal data by seed expressions and bootstrapped contextual extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import frozen, release
from .common import NON_WORD, let, lower_ascii, packed, text_of
from .decontam import item_words, rarity

# The seed expressions, in the order in which kinds are listed. What can't give back
# is possessive, so long texts neither recurse nor backtrack; an address can only begin where its
# first part does, or where the match before ended.
_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without these has no match
_NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+"}

_APART = "(?<![A-Za-z0-9@._+-])"
_ENDS = "(?![A-Za-z0-9@_]|[.+-][A-Za-z0-9])"
_MORE = "(?![A-Za-z0-9@_]|[.+][A-Za-z0-9]|-[A-Za-z])"  # a hyphen may lead to the next group
_GROUP = r"(?:\([0-9]{1,5}\)|[0-9]{2,9}+)"
_TOKEN = "[A-Za-z0-9]++(?:[@._+-]++[A-Za-z0-9]++)*+"
#: what a pattern may extract, at one place the first of: groups of digits with spaces, brackets or
#: slashes between them; groups of four as in an IBAN; runs of at least five characters with a digit
#: among them; shorter ones with a digit; after a label and its colon, tokens without one
CANDIDATE = "|".join(
    [
        rf"{_APART}{_GROUP}(?:[\x20/-]{{0,3}}(?<![0-9]){_GROUP}{_MORE})++",
        rf"{_APART}[A-Z]{{2}}[0-9]{{2}}(?:\x20[A-Z0-9]{{4}}{_ENDS}){{2,7}}+(?:\x20[0-9]{{1,4}}{_ENDS})?+",
        rf"(?:{_APART}|\G)(?=[A-Za-z@._+-]*+[0-9])[A-Za-z0-9@._+-]{{5,}}+",
        rf"(?<![A-Za-z0-9@._+])(?=[A-Za-z@._+-]*+[0-9]){_TOKEN}",
        rf"(?<=[A-Za-z0-9][:=#]\x20{{0,2}}){_TOKEN}",
    ]
)
#: candidates that are taken after a sure pattern but make no pattern sure
_WEAK = "^.{0,4}$|^[^0-9]*$"
#: what stands between the members of a list
_LIST = r"^\s*(?:(?:[,;/&|]|and\s|or\s)\s*)+$"
#: a label: a word with a colon, an equals sign or a number sign, and perhaps an opening quote
LABEL = r"(?<![a-z0-9_-])[a-z][a-z0-9_-]*+\x20{0,2}+[:=#]\x20{0,2}+[\"']?+"
#: a candidate that looks like a key or a token by itself: long, with digits and letters mixed
_KEY = r"^(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^a-z]*+[a-z]){2})[a-z0-9_+-]{12,}$"
KEY_SCORE = 0.6  # of such a candidate behind a label, where those of the expressions have 1
CONTEXT = "context"  # the kind of what only a pattern found
ROUNDS = 3  # at least; more follow while they change anything
RISE = 0.01  # of a score by which a round still changes something
SUPPORT = 5  # different entities that a pattern must have met
SURE = 0.5  # of all places of a pattern's word that an entity follows

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_NEAR = 80  # characters before a match in which its left word is looked for


def _spaced(label: Column) -> Column:
    return F.regexp_replace(label, "\x20+", " ")


def _phrases(text: Column) -> Column:
    """All words and labels of a text, each as often as it stands there."""
    labels = F.transform(F.regexp_extract_all(lower_ascii(text), F.lit(LABEL), F.lit(0)), _spaced)
    none = F.array().cast("array<string>")
    return F.concat(item_words(text), F.when(text.rlike("[:=#]"), labels).otherwise(none))


def _matches(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """The matches of one kind as structs; places follow from the lengths of gaps and matches."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def rows(parts: Column) -> Column:
        return F.transform(
            parts["values"],
            lambda v, k: F.struct(
                F.lit(kind).alias("kind"),
                k.alias("k"),
                F.length(F.get(parts["gaps"], k)).alias("gap"),
                F.length(v).alias("size"),
                v.alias("value"),
                F.substring(F.get(parts["gaps"], k), -_NEAR, _NEAR).alias("near"),
            ),
        )

    return F.when(
        text.rlike(needs), let(F.struct(gaps.alias("gaps"), values.alias("values")), rows)
    )


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double."""

    def worth(i: Column) -> Column:
        v = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    kind, value = F.col("kind"), F.col("value")
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def entities(docs: DataFrame) -> DataFrame:
    """One row for each seed entity and candidate, and one with null kind for each document.

    ``rid`` tells documents apart, ``start`` and ``end`` count code points, ``left`` has the word
    before and the label right before, if any; members of a list have those of its first. ``votes`` tells whether the place counts for
    its word: the first of a list does, a candidate that is short or has no digit doesn't.
    Candidates that overlap a seed entity are left out. Only documents with digits, an at sign or
    a label bring more than one row to the shuffle by ``rid``.
    """
    text = F.col("body")
    parts = [_matches(text, k, p, _NEEDS[k]) for k, p in KINDS.items()]
    parts.append(_matches(text, CONTEXT, CANDIDATE, "[0-9]|[A-Za-z][:=#]"))
    element = "struct<kind: string, k: int, gap: int, size: int, value: string, near: string>"
    none = F.array().cast(f"array<{element}>")
    alone = F.array(F.lit(None).cast(element))
    found = F.concat(alone, *[F.coalesce(p, none) for p in parts])
    rows = (
        packed(docs)
        .select(F.monotonically_increasing_id().alias("rid"), "row.doc_id", text_of("row.text").alias("body"))
        .select("rid", "doc_id", F.explode(found).alias("m"))
        .select("rid", "doc_id", "m.*")
        .repartition("rid")
    )
    upto = Window.partitionBy("rid", "kind").orderBy("k")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    near = lower_ascii(F.col("near"))
    word = F.try_element_at(F.array_remove(F.split(near, NON_WORD), ""), F.lit(-1))
    label = _spaced(F.regexp_extract(near, f"{LABEL}$", 0))
    heads = (F.col("k") == 0) | (F.col("gap") > _NEAR) | ~F.col("near").rlike(_LIST)
    weak = (F.col("kind") == CONTEXT) & F.col("value").rlike(_WEAK)
    placed = (
        rows.withColumn("end", end)
        .withColumn("pair", F.last(F.when(heads, F.struct(word.alias("w"), label.alias("l"))), True).over(upto))
        .withColumn("left", F.array_compact(F.array("pair.w", F.nullif("pair.l", F.lit("")))))
        .withColumn("votes", heads & ~weak)
        .withColumn("start", F.col("end") - F.col("size"))
        .filter(F.col("kind").isNull() | _valid())
    )
    seed = F.col("kind").isNotNull() & (F.col("kind") != CONTEXT)
    order = Window.partitionBy("rid").orderBy("start", "end", "kind")
    reached = F.max(F.when(seed, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    follows = F.min(F.when(seed, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    return (
        placed.withColumn("reached", reached)
        .withColumn("follows", follows)
        .filter(
            (F.coalesce(F.col("kind"), F.lit("")) != CONTEXT)
            | (
                (F.coalesce("reached", F.lit(-1)) <= F.col("start"))
                & F.coalesce(F.col("follows") >= F.col("end"), F.lit(True))
            )
        )
        .select("rid", "doc_id", "kind", "start", "end", "left", "votes", F.lower("value").alias("value"))
    )


def patterns(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``left``, ``sure`` and ``met`` of the words and labels that identify what follows them.

    A pattern is the word left of an entity, or its label with the signs between (``token = "``).
    The graph has an edge for each pattern and entity that met, with how often. Seeds have score 1;
    what looks like a key or token behind a label has ``KEY_SCORE``, so that a label makes itself
    sure if nearly all it introduces are keys. In each round a pattern's score is the sum of
    its entities' scores over all places where its word stands in the corpus, so that frequent
    words don't become patterns; it counts only if it met ``SUPPORT`` different entities. An
    entity that is no seed gets the score that at least one of its patterns is right. Scores only
    rise, so after ``rounds`` rounds it goes on until a round makes no pattern and no entity sure
    that wasn't, and raises no score by ``RISE``. Edges are added up before they are joined, so a hot word or entity is one row for
    each partner.
    """
    edges = frozen(
        found.filter("kind is not null and votes")
        .withColumn("left", F.explode("left"))
        .groupBy("left", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(
                F.when(F.col("kind") != CONTEXT, 1.0)
                .when(F.col("left").rlike("[:=#]") & F.col("value").rlike(_KEY), KEY_SCORE)
                .otherwise(0.0)
            ).alias("seed"),
        )
    )
    words = frozen(
        edges.groupBy("left").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") >= SUPPORT)
    )
    counted = rarity(texts, words.select(F.col("left").alias("token")))
    usable = frozen(words.join(counted, F.col("left") == F.col("token")).select("left", "seen"))
    graph = frozen(edges.join(usable, "left"))
    seeds = edges.groupBy("value").agg(F.max("seed").alias("seed"))
    scores = frozen(seeds.select("value", "seed", F.col("seed").alias("score"), F.lit(0.0).alias("rise")))
    turn, before = 0, None
    while True:
        rated = frozen(_rated(graph, scores))
        (sure,) = rated.agg(F.count_if(F.col("sure") >= SURE)).first()
        known, rise = scores.agg(F.count_if(F.col("score") >= SURE), F.max("rise")).first()
        if turn >= rounds and (sure, known) == before and (rise or 0) < RISE:
            return rated.filter(F.col("sure") >= SURE)
        turn, before = turn + 1, (sure, known)
        miss = F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))
        reached = (
            graph.select("left", "value")
            .join(rated, "left")
            .groupBy("value")
            .agg((1 - F.exp(F.sum(miss))).alias("reached"))
        )
        following = frozen(
            scores.join(reached, "value", "left")
            .withColumn("now", F.greatest("seed", F.coalesce("reached", F.lit(0.0))))
            .select("value", "seed", F.col("now").alias("score"), (F.col("now") - F.col("score")).alias("rise"))
        )
        release(scores, rated)
        scores = following


def _rated(graph: DataFrame, scores: DataFrame) -> DataFrame:
    weight = F.sum(F.col("n") * F.col("score")) / F.greatest(F.max("seen"), F.lit(1))
    return (
        graph.join(scores.select("value", "score"), "value")
        .groupBy("left")
        .agg(
            F.least(F.lit(1.0), weight).alias("sure"),
            F.count_if(F.col("score") >= SURE).alias("met"),
        )
        .filter(F.col("met") >= SUPPORT)
    )


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id`` and ``spans`` (start, place of the kind, kind, end; in order) of each row.

    Seed spans come from the expressions, leftmost and non-overlapping per kind, those that fail
    their check dropped. Candidates after a sure pattern's word, and those that continue a list
    there, are added with kind "context".
    Null and empty texts have no spans; repeated rows stay.
    """
    found = frozen(entities(docs))
    sure = frozen(patterns(found, docs.select(_phrases(text_of()).alias("w")), rounds).select("left"))
    context = F.col("kind") == CONTEXT
    added = (
        found.filter(context)
        .withColumn("pattern", F.explode("left"))
        .join(sure.withColumnRenamed("left", "pattern"), "pattern", "left_semi")
        .select(*found.columns)
        .distinct()  # both of its patterns may be sure
    )
    kept = found.filter(F.col("kind").isNull() | ~context).unionByName(added)
    place = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, CONTEXT]]), F.col("kind"))
    span = F.when(
        F.col("kind").isNotNull(),
        F.struct("start", place.alias("place"), "kind", "end"),
    )
    return (
        kept.groupBy("rid")
        .agg(
            F.max(F.when(F.col("kind").isNull(), F.col("doc_id"))).alias("doc_id"),
            F.array_sort(F.collect_list(span)).alias("spans"),
        )
        .select("doc_id", "spans")
    )
