"""Secrets in text: fixed patterns, and random strings told from ordinary identifiers by two Markov models.

DataFrame functions only. Places count code points; ends are exclusive.
"""

from __future__ import annotations

import json
import math
import string
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns: name, expression, the group whose length counts, that length. Keywords are read in either case.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
# Cheaper expressions that every counted match satisfies, to leave most texts alone.
_SIGNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
}
RANDOM = "random"
KINDS = (*(b[0] for b in BASE), RANDOM)
_TOKEN = "[A-Za-z0-9+/_=-]{20,}"
_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPANS = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"


# Elements that a fold takes at a time: what it appends to stays short, so that its time is linear in the text.
_BLOCK = 256

# Words that made-up identifiers, paths and addresses are put together from.
_WORDS = (
    "about account action add admin after agent all and api app archive array article asset auth available backup bank base "
    "batch before begin between binary block body book branch brown buffer build bundle button cache call camera channel "
    "check child city class clean client close cloud code column command comment commit common component config connection "
    "container content context control copy core count country create current customer data date debug default delete "
    "description design detail development device directory display document domain download driver edit element email "
    "enable engine entry error event example export factory feature field file filter find first fox frame function garden "
    "get global graph group handler header height history home host house id image import include index info input insert "
    "instance int interface internal international item java join jump key language last layout lazy length level lib "
    "library license line link list local location log machine main manager map market message method module month name "
    "network new node northern number object of on open option or order output over package page parent parser path "
    "przewodnik queue quick read record release request response result return river root route row run schema search "
    "server service session set site size source state string system szczegolny table tag target task test text the "
    "theme thread time to token tree type update upload url user usr value version view warszawa web window word xml "
    "year zeitschrift grzegorz brzeczyszczykiewicz wojciech"
).split()
WORDS_KIND, HEX_KIND, RUN_KIND = "words", "hex", "run"


@dataclass(frozen=True)
class RandomModel:
    """Per kind of ordinary string the log-likelihood ratio (random over ordinary) of each pair of characters, and the least
    mean that counts as random. A string is as random as the kind that explains it best lets it be."""

    ratios: dict[str, dict[str, float]]
    least_mean: float


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fold(items: Column, state: Column, out: Column, step) -> Column:
    """What ``step(state, out, item)``, which returns a struct of both, has put out once all items are through, and the last
    state: ``struct<state, outs>``; ``outs`` holds one array per block of items."""

    def folded(all_items: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / _BLOCK).cast("int")),
            lambda k: F.slice(all_items, k * _BLOCK + 1, F.lit(_BLOCK)),
        )
        blocks = F.when(F.size(all_items) > 0, blocks).otherwise(F.slice(F.array(all_items), F.lit(1), F.lit(0)))

        def through(done: Column, block: Column) -> Column:
            return F.aggregate(
                block,
                F.struct(done["state"].alias("state"), out.alias("out")),
                lambda now, item: step(now["state"], now["out"], item),
                lambda now: F.struct(now["state"].alias("state"), F.concat(done["outs"], F.array(now["out"])).alias("outs")),
            )

        return F.aggregate(blocks, F.struct(state.alias("state"), F.slice(F.array(out), F.lit(1), F.lit(0)).alias("outs")), through)

    return _let(items, folded)


def _matches(text: Column, sign: str, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Leftmost, non-overlapping matches as spans, in order; failing ones take their place, then go."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    pairs = F.arrays_zip(F.split(text, pattern).alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(at: Column, out: Column, pair: Column) -> Column:
        start = at + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.struct(
            start.alias("start"),
            end.alias("end"),
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("kind"),
            pair["value"].alias("value"),
        )
        counts = F.length(pair["value"]) >= least  # null for the last gap, behind which nothing matched
        return F.struct(end.alias("state"), F.when(counts, F.concat(out, F.array(span))).otherwise(out).alias("out"))

    none = F.array().cast(_SPANS)
    found = F.flatten(_fold(pairs, F.lit(0), none, step)["outs"])
    return F.when(text.rlike(sign), found).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        kind: _matches(text, _SIGNS[kind], pattern, group, least, rank, kind)
        for rank, (kind, pattern, group, least) in enumerate(BASE)
    }


def labelled_samples(docs: DataFrame, max_docs: int = 2000, text_column: str = "text") -> DataFrame:
    """``(value, is_random, kind)`` from about ``max_docs`` documents that hold base matches and as many that hold none.

    Matched values are random strings (access keys without their fixed prefix), words of 8 or more characters of the
    other documents are ordinary. The documents are chosen by a hash of their text; equal texts count once.
    """
    text = F.col("text")
    rows = docs.select(F.col(text_column).cast("string").alias("text"))
    has = F.lit(False)
    for sign in _SIGNS.values():
        has = has | text.rlike(sign)
    rows = rows.filter(text.isNotNull()).withColumn("secret", has)
    different = rows.groupBy("secret").agg(F.count_distinct(F.xxhash64(text)).alias("n"))
    share = {r["secret"]: min(1.0, max_docs / r["n"]) for r in different.collect()}
    chosen = F.pmod(F.xxhash64(F.lit("secret sample"), text), F.lit(1_000_003)) / 1_000_003
    limit = F.when(F.col("secret"), share.get(True, 0.0)).otherwise(share.get(False, 0.0))
    # The hash is cheaper than the patterns, and most rows fail it.
    rows = rows.filter((chosen < max(share.values(), default=0.0)) & (chosen < limit)).distinct()
    spans = F.concat(*base_spans(text).values())
    random = rows.filter("secret").select(F.explode(spans).alias("s"))
    random = random.select(F.regexp_replace("s.value", "^AKIA", "").alias("value"), F.lit(True).alias("is_random"))
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]{8,}"), F.lit(0))
    ordinary = rows.filter("NOT secret").select(F.explode(words).alias("value"), F.lit(False).alias("is_random"))
    return random.unionByName(ordinary).withColumn("kind", F.lit(WORDS_KIND))


def made_samples(spark: SparkSession, each: int = 2000) -> DataFrame:
    """``(value, is_random, kind)``: made-up strings, ``each`` of every sort, the same in every run.

    Random ones in 62 and 64 characters; ordinary ones as identifiers, paths, addresses and names put together from
    words, as hexadecimal numbers and times with dashes, and as runs of one character or of neighbours in the alphabet.
    """
    words = F.array(*[F.lit(w) for w in _WORDS])

    def pick(k: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(_WORDS))))

    def number(k: int, high: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(-k)), F.lit(high)).cast("string")

    def draw(name: str) -> Column:
        return F.sha2(F.concat_ws("-", F.lit(name), F.col("id").cast("string")), 256)

    rows = spark.range(0, each, 1, 1)
    stop = (F.pmod(F.xxhash64("id", F.lit("length")), F.lit(24)) + 20).cast("int")
    sorts = [
        (True, WORDS_KIND, F.substr(F.base64(F.unhex(draw("64"))), F.lit(1), stop)),
        (True, WORDS_KIND, F.substr(F.translate(F.base64(F.unhex(draw("62"))), "+/=", "xY7"), F.lit(1), stop)),
        (False, WORDS_KIND, F.concat_ws("_", pick(1), pick(2), pick(3), F.concat(pick(4), number(1, 10)))),
        (False, WORDS_KIND, F.concat(pick(1), *[F.initcap(pick(k)) for k in range(2, 6)])),
        (False, WORDS_KIND, F.concat_ws("/", F.lit(""), *[pick(k) for k in range(1, 4)], F.concat_ws("-", pick(4), pick(5)))),
        (False, WORDS_KIND, F.concat_ws("/", F.lit(""), pick(1), F.concat(F.lit("20"), number(1, 90)), number(2, 12), F.concat_ws("-", *[pick(k) for k in range(2, 6)]))),
        (False, WORDS_KIND, F.upper(F.concat_ws("_", *[pick(k) for k in range(1, 5)]))),
        (False, WORDS_KIND, F.concat_ws("-", F.initcap(pick(1)), F.initcap(pick(2)), F.initcap(pick(3)))),
        (False, HEX_KIND, F.concat_ws("-", *[F.substr(draw("hex"), F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])),
        (False, HEX_KIND, F.concat_ws("-", F.substr(draw("hex"), F.lit(30), F.lit(7)), F.concat(F.lit("20"), number(1, 90)), number(2, 12), number(3, 30), number(4, 10**9))),
        (False, RUN_KIND, F.repeat(F.chr(F.pmod("id", F.lit(26)) + F.when(F.col("id") % 2 == 0, 65).otherwise(97)), stop)),
        (False, RUN_KIND, F.repeat(F.get(F.array(*map(F.lit, "0=-_/+9")), F.pmod("id", F.lit(7))), stop)),
        (False, RUN_KIND, F.lit(f"{string.ascii_uppercase}{string.ascii_lowercase}{string.digits}")),
    ]
    values = [F.struct(v.alias("value"), F.lit(r).alias("is_random"), F.lit(k).alias("kind")) for r, k, v in sorts]
    return rows.select(F.inline(F.array(*values)))


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), "value"), F.lit(2)) == 1


def train(samples: DataFrame, smoothing: float = 0.5, each: int = 2000) -> RandomModel:
    """First-order models of random and of each kind of ordinary strings, and the least mean ratio that tells them apart.

    ``samples`` are ``(value, is_random, kind)``; nulls are left out, and :func:`made_samples` are added, ``each`` of every
    sort. Pairs are counted in Spark; their number is that of pairs of 67 characters at most. Random strings get a share of
    the uniform model, so that characters no sample had are no surprise there. Of the made samples one half is counted; on
    the other half the least mean is chosen so that the larger of both error rates is smallest.
    """
    made = made_samples(samples.sparkSession, each)
    known = samples.filter("value IS NOT NULL AND is_random IS NOT NULL AND length(value) > 1")
    known = known.select("value", "is_random", "kind").unionByName(made.filter(~_held_out()))
    places = F.sequence(F.lit(1), F.length("value") - 1)
    label = F.when(F.col("is_random"), RANDOM).otherwise(F.col("kind")).alias("label")
    pairs = known.select(label, F.explode(F.transform(places, lambda i: F.substr("value", i, F.lit(2)))).alias("pair"))
    counts: dict[str, dict[str, int]] = {label: {} for label in (RANDOM, WORDS_KIND, HEX_KIND, RUN_KIND)}
    for label, pair, n in pairs.filter(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").count().collect():
        counts.setdefault(label, {})[pair] = n
    size = len(_CHARACTERS)
    logs: dict[str, dict[str, float]] = {}
    for label, seen in counts.items():
        logs[label] = {}
        for a in _CHARACTERS:
            total = sum(seen.get(a + b, 0) for b in _CHARACTERS) + smoothing * size
            for b in _CHARACTERS:
                p = (seen.get(a + b, 0) + smoothing) / total
                logs[label][a + b] = math.log(0.5 * p + 0.5 / size if label == RANDOM else p)
    ratios = {k: {pair: logs[RANDOM][pair] - own[pair] for pair in own} for k, own in logs.items() if k != RANDOM}
    model = RandomModel(ratios, 0.0)
    steps = F.round(mean_ratio(F.col("value"), model) * 100).cast("int").alias("step")
    test = made.filter(_held_out()).filter(F.length("value") >= 20).select("is_random", steps)
    found = test.groupBy("is_random", "step").count().collect()
    totals = {r: sum(x["count"] for x in found if x["is_random"] == r) for r in (True, False)}

    def error(cut: int) -> float:
        missed = sum(x["count"] for x in found if x["is_random"] and x["step"] < cut)
        wrong = sum(x["count"] for x in found if not x["is_random"] and x["step"] >= cut)
        return max(missed / max(1, totals[True]), wrong / max(1, totals[False]))

    cuts = range(min((x["step"] for x in found), default=0), max((x["step"] for x in found), default=0) + 2)
    least = min(map(error, cuts))
    best = [cut for cut in cuts if error(cut) == least]
    return RandomModel(ratios, (best[0] + best[-1]) / 200)


def _ratios(model: RandomModel) -> list:
    """Per kind of ordinary string, words first, its mean log-likelihood ratio as a function of a column."""
    out = []
    for kind in sorted(model.ratios, key=lambda k: (k != WORDS_KIND, k)):
        flat = [0.0] * (128 * 128)
        for pair, ratio in model.ratios[kind].items():
            flat[ord(pair[0]) * 128 + ord(pair[1])] = round(ratio, 6)
        table = F.from_json(F.lit(json.dumps(flat)), "array<double>")
        out.append(partial(_mean_ratio, table=table))
    return out


def _reaches(ratio, least: float, part: Column) -> Column:
    return ratio(part["seen"]) >= least


def mean_ratio(value: Column, model: RandomModel) -> Column:
    """Of a string of two or more characters, the mean log-likelihood ratio against the kind that explains it best."""
    means = [ratio(value) for ratio in _ratios(model)]
    return F.least(*means) if len(means) > 1 else means[0]


# Pieces of a run whose characters are looked up by place; each holds the first character of the next.
_PIECES = r"(?s)(?=(.{1,1025})).{1,1024}"


def _mean_ratio(value: Column, table: Column) -> Column:
    def ratios(piece: Column) -> Column:
        def code(place: Column) -> Column:
            return F.ascii(F.substr(piece, place, F.lit(1)))

        places = F.when(F.length(piece) > 1, F.sequence(F.lit(1), F.length(piece) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.lit(0.0), lambda t, i: t + F.get(table, code(i) * 128 + code(i + 1)))

    cut = F.regexp_extract_all(value, F.lit(_PIECES), F.lit(1))
    pieces = F.when(F.length(value) <= 1024, F.array(value)).otherwise(cut)
    total = F.aggregate(F.transform(pieces, ratios), F.lit(0.0), lambda t, r: t + r)
    return total / (F.length(value) - 1)


def find_secrets(
    docs: DataFrame, model: RandomModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, text, base, added)``: all base spans, and spans of random strings outside of them, by start.

    A candidate is a run of 20 or more of the characters ``A-Za-z0-9+/_=-``, or each part of such a run that base spans
    leave; it is random if its mean log-likelihood ratio reaches the model's, that of a part with the characters of the
    run that it borders on. A null text counts as an empty one: no spans.
    Repeated rows and ids each get their row; other columns are not read. Rows stay where they are.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", F.array_sort(F.concat(*base_spans(text).values())))
    tokens = _matches(text, _TOKEN, _TOKEN, 0, 20, len(BASE), RANDOM)
    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,value:string,seen:string>>")

    def part(run: Column, start: Column, end: Column) -> Column:
        """A part of a run, and with the characters beside it as ``seen``."""
        first = F.greatest(start - 1, run["start"])
        return F.struct(
            start.alias("start"),
            end.alias("end"),
            run["rank"].alias("rank"),
            run["kind"].alias("kind"),
            F.substr(run["value"], start - run["start"] + 1, end - start).alias("value"),
            F.substr(run["value"], first - run["start"] + 1, F.least(end + 1, run["end"]) - first).alias("seen"),
        )

    def step(state: Column, out: Column, span: Column) -> Column:
        """One sweep over base spans and runs by start: ``at`` is where the open run is not covered yet."""
        run, at = state["run"], state["at"]
        is_run = span["rank"] == len(BASE)
        # A run ends the one before it; a base span covers what it can of the open one.
        stop = F.when(is_run, run["end"]).otherwise(F.least(span["start"], run["end"]))
        free = F.when(at < stop, F.concat(out, F.array(part(run, at, stop)))).otherwise(out)
        covered = F.greatest(state["covered"], F.when(is_run, F.lit(0)).otherwise(span["end"]))
        now = F.struct(
            F.when(is_run, span).otherwise(run).alias("run"),
            F.when(is_run, F.greatest(span["start"], covered)).otherwise(F.greatest(at, span["end"])).alias("at"),
            covered.alias("covered"),
        )
        return F.struct(now.alias("state"), free.alias("out"))

    nowhere = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(len(BASE)).alias("rank"), F.lit(RANDOM).alias("kind"), F.lit("").alias("value")
    )
    begin = F.struct(nowhere.alias("run"), F.lit(0).alias("at"), F.lit(0).alias("covered"))

    def uncovered(spans: Column) -> Column:
        # A last, empty run behind all others ends the sweep.
        last = nowhere.withField("start", F.lit(2**31 - 1)).withField("end", F.lit(2**31 - 1))
        return F.flatten(_fold(F.concat(spans, F.array(last)), begin, none, step)["outs"])

    def swept(found: Column) -> Column:
        spans = F.array_sort(F.concat("base", found))
        return F.when(F.size(found) > 0, uncovered(spans)).otherwise(none)

    parts = F.filter(_let(tokens, swept), lambda p: F.length(p["seen"]) > 1)
    random = parts
    for ratio in _ratios(model):  # most runs are explained by the first kind, and looked at no further
        random = F.filter(random, partial(_reaches, ratio, model.least_mean))
    return rows.withColumn("added", F.transform(random, lambda p: p.dropFields("seen")).cast(_SPANS))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each span, or run of spans that overlap, replaced by one mask."""

    width = 4096

    def masked(pieces: Column) -> Column:
        # A place is found within its piece of the text, not from the beginning of the text.
        def between(start: Column, end: Column) -> Column:
            first = F.floor(start / width).cast("int")
            here = F.array_join(F.slice(pieces, first + 1, F.floor(end / width).cast("int") - first + 1), "")
            return F.substr(here, start - first * width + 1, end - start)

        def step(at: Column, out: Column, span: Column) -> Column:
            fresh = F.concat(out, F.array(between(at, span["start"]), F.lit(mask)))
            return F.struct(
                F.greatest(at, span["end"]).alias("state"), F.when(span["start"] >= at, fresh).otherwise(out).alias("out")
            )

        def joined(done: Column) -> Column:
            return F.concat(F.array_join(F.flatten(done["outs"]), ""), between(done["state"], F.length(text)))

        return _let(_fold(F.array_sort(spans), F.lit(0), F.array().cast("array<string>"), step), joined)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(pieces, masked)).otherwise(text)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts per base kind, a hash of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_column,
        *[count(b[0]) for b in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
