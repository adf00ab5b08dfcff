"""Personal data in risk reports: candidate spans scored by gradient-boosted trees. Only DataFrame functions are used.

Text records of this project are the per-user risk reports (``user_id``, ``report``); the column arguments name any other.
The base rules decide by fixed tests (a domain, parts of at most 255, the Luhn sum, a plus sign). The method adds spans: generators with looser
forms propose candidates, boosted trees score their format and context, and a threshold per kind, calibrated on held-out candidates, selects.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import cut_lineage, drop_written, unpacked

# fixed values: kinds in the order in which they are listed
KINDS = ("email", "ip", "card", "phone")
# fixed values: the base forms. A form starts where a run of its first class starts or where the last hit ended, which
# are the only places where its leftmost hit can start; possessive repeats then read every run once.
BASE_FORMS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
SMALL_PARTS = rf"^{PART}(?:\.{PART}){{3}}$"
# looser forms of the same kinds: spelled-out signs, blanks around dots, other separators, no plus sign
LOOSE_FORMS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9.])",
    r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){12,18}(?![0-9])",
    r"(?<![0-9+(])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,2}[0-9]){7,14}(?![0-9])",
)
# fixed values: words that announce a kind, in English, German, French and Spanish
ANNOUNCED = (
    r"(?i)mail|contact|kontakt|correo|courriel",
    r"(?i)\bips?\b|address|adresse|host|server",
    r"(?i)card|karte|carte|tarjeta|visa|credit|kredit",
    r"(?i)phone|\btel|call|fon|ruf|mobil|cell",
)
# what the trees see; the tests of the base rules are not among it, so that the score says how alike a candidate is apart from them
FEATURES = ("kind", "chars", "digits", "letters", "marks", "groups", "longest", "shortest", "before", "after", "announced", "blank_around", "dots")
MOST_VALUE, CONTEXT, RUN = 31, 24, 256
# rows the classifier learns from at most; rounds, depth and step of boosting; smallest weight of a side
SAMPLE, ROUNDS, DEPTH, STEP, RIDGE, LEAST_WEIGHT = 20_000, 12, 3, 0.4, 1.0, 4.0
# share of true candidates that a threshold has to keep above it, and the bins of the score
PRECISION, SCORE_BINS = 0.95, 40


# ---- candidates ----

CANDIDATE = "struct<first:bigint,kind:int,last:bigint,base:boolean,features:array<int>>"
NO_CANDIDATES = f"array<{CANDIDATE}>"


def _scan(array: str, kind: str, start: Column, step, emit) -> Column:
    """``emit(state, x)`` of every element, the state going from ``start`` by ``step(state, x)``.

    The list is worked off in runs of ``RUN`` elements, as an array that grows element by element costs the square of its length.
    """
    run = lambda i: F.slice(array, i * RUN + 1, RUN)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / RUN).cast("int")), run)
    empty = F.array().cast(f"array<{kind}>")
    inner = lambda at, xs: F.aggregate(
        xs, F.struct(at.alias("at"), empty.alias("out")), lambda t, x: F.struct(step(t["at"], x).alias("at"), F.concat(t["out"], F.array(emit(t["at"], x))).alias("out"))
    )
    outer = F.aggregate(
        runs, F.struct(F.struct(start.alias("at"), empty.alias("out")).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("all")),
        lambda t, xs: F.struct(inner(t["last"]["at"], xs).alias("last"), F.concat(t["all"], F.array(t["last"]["out"])).alias("all")),
        lambda t: F.flatten(F.concat(t["all"], F.array(t["last"]["out"]))),
    )
    return F.when(F.size(array) > 0, outer)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda t, i: t + doubled(i)) % 10 == 0


def _is_valid(kind: int, item: Column) -> Column:
    n = F.length(item["digits"])
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return item["hit"].rlike(SMALL_PARTS)
    return F.when(n.between(14, 19), _luhn(item["digits"])).otherwise(F.lit(False)) if kind == 2 else n.between(10, 15)


def _features(kind: int, item: Column) -> Column:
    hit, groups = item["hit"], item["groups"]
    beside = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[A-Za-z0-9_]$"), 2).otherwise(3)
    count = lambda pattern: F.length(F.regexp_replace(hit, pattern, ""))
    values = (
        F.lit(kind), F.length(hit), F.length(item["digits"]), count("[^A-Za-z]"), count("[A-Za-z0-9]"), F.size(groups), F.coalesce(F.array_max(groups), F.lit(0)),
        F.coalesce(F.array_min(groups), F.lit(0)), beside(F.right(item["before"], F.lit(1))), beside(F.left(item["after"], F.lit(1))),
        item["before"].rlike(ANNOUNCED[kind]).cast("int"), hit.rlike(r"\s").cast("int"), count("[^.]"),
    )
    return F.array(*[F.least(v.cast("int"), F.lit(MOST_VALUE)) for v in values])


def _worth_a_look(text: Column, kind: int, loose: bool) -> Column:
    """A cheap test without which no hit is possible."""
    if kind == 0:
        return (text.contains("@") | text.contains("(at)") | text.contains("[at]")) if loose else text.contains("@")
    return text.contains("+") if kind == 3 and not loose else text.rlike("[0-9]")


def _candidates(df: DataFrame, text: str, name: str, kind: int, loose: bool) -> DataFrame:
    """Adds array ``name`` of one generator's candidates: first, kind, last (code points, end exclusive), base (meets the base rule), features.

    Every step is a column of its own, so that no expression is evaluated twice. A text between hits is split off once, and starts are running sums.
    """
    form = (LOOSE_FORMS if loose else BASE_FORMS)[kind]
    look = _worth_a_look(F.col(text), kind, loose)
    df = df.withColumn("_hits", F.when(look, F.regexp_extract_all(F.col(text), F.lit(form), F.lit(0))))
    df = df.withColumn("_pieces", F.when(F.size("_hits") > 0, F.split(F.col(text), form, -1)))
    piece = lambda i: F.get("_pieces", i)
    item = lambda h, i: F.struct(
        F.length(piece(i)).cast("bigint").alias("gap"), F.length(h).cast("bigint").alias("size"), h.alias("hit"), F.right(piece(i), F.lit(CONTEXT)).alias("before"),
        F.left(piece(i + 1), F.lit(CONTEXT)).alias("after"), F.regexp_replace(h, "[^0-9]", "").alias("digits"),
        F.transform(F.regexp_extract_all(h, F.lit("[0-9]+"), F.lit(0)), F.length).alias("groups"),
    )
    df = df.withColumn("_items", F.when(F.size("_hits") > 0, F.transform("_hits", item)))
    df = df.withColumn("_starts", _scan("_items", "bigint", F.lit(0).cast("bigint"), lambda at, x: at + x["gap"] + x["size"], lambda at, x: at + x["gap"]))
    made = lambda x, first: F.struct(
        first.alias("first"), F.lit(kind).alias("kind"), (first + x["size"]).alias("last"), (F.lit(not loose) & _is_valid(kind, x)).alias("base"), _features(kind, x).alias("features")
    )
    found = F.zip_with("_items", "_starts", made)
    if kind == 2 and not loose:  # any two digits have the form; only hits of about a card's length are candidates
        found = F.filter(found, lambda c: c["features"][2].between(12, 20))
    none = F.array().cast(NO_CANDIDATES)
    return df.withColumn(name, F.coalesce(found, none)).drop("_hits", "_pieces", "_items", "_starts")


def _clashes(df: DataFrame) -> DataFrame:
    """``other`` becomes an array of (c, clash): whether the candidate overlaps a base span. A sorted list tells it in one pass each way."""
    far, near = F.lit(1 << 62).cast("bigint"), F.lit(0).cast("bigint")
    df = df.withColumn("_both", F.when(F.size("other") > 0, F.array_sort(F.concat("base", "other")))).withColumn("_back", F.reverse("_both"))
    ahead = _scan("_both", "boolean", near, lambda at, c: F.greatest(at, F.when(c["base"], c["last"]).otherwise(near)), lambda at, c: c["first"] < at)
    behind = _scan("_back", "boolean", far, lambda at, c: F.least(at, F.when(c["base"], c["first"]).otherwise(far)), lambda at, c: c["last"] > at)
    df = df.withColumn("_clash", F.zip_with(ahead, F.reverse(behind), lambda a, b: a | b))
    marked = F.zip_with("_both", "_clash", lambda c, clash: F.struct(c.alias("c"), clash.alias("clash")))
    none = F.array().cast(f"array<struct<c:{CANDIDATE},clash:boolean>>")
    return df.withColumn("other", F.coalesce(F.filter(marked, lambda m: ~m["c"]["base"]), none)).drop("_both", "_back", "_clash")


def propose(reports: DataFrame, report: str = "report", carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` (default all) as ``row``, ``base``: the spans that meet a base rule, and ``other``: the further candidates.

    ``other`` holds (c, clash); a candidate that clashes overlaps a base span and can neither be added nor teach anything.
    """
    names = reports.columns if carry is None else carry
    df = reports.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{report}`"), F.lit("")).alias("text"))
    for kind in range(len(KINDS)):
        for loose in (False, True):
            df = _candidates(df, "text", f"c{kind}{int(loose)}", kind, loose)
    base = F.array_sort(F.concat(*[F.filter(f"c{k}0", lambda c: c["base"]) for k in range(4)]))
    other = F.concat(*[F.filter(f"c{k}{loose}", lambda c: ~c["base"]) for k in range(4) for loose in (0, 1)])
    return _clashes(df.select("row", base.alias("base"), other.alias("other")))


# ---- boosting ----


@dataclass(frozen=True)
class SpanModel:
    """Trees over the features (each a nested (feature, value, left, right) or a leaf), the start score, and a threshold per kind."""

    start: float
    trees: list
    thresholds: list[float]

    def margin(self, features: Column) -> Column:
        out = F.lit(self.start)
        for tree in self.trees:
            out = out + _tree_value(tree, features)
        return out


def _tree_value(tree, features: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    at, value, left, right = tree
    return F.when(features[at] <= value, _tree_value(left, features)).otherwise(_tree_value(right, features))


def _node_number(tree, features: Column) -> Column:
    """Number of the open leaf (an int) a row falls into; finished leaves are -1."""
    if isinstance(tree, int):
        return F.lit(tree)
    if isinstance(tree, float):
        return F.lit(-1)
    at, value, left, right = tree
    return F.when(features[at] <= value, _node_number(left, features)).otherwise(_node_number(right, features))


def _filled(tree, leaves: dict):
    if isinstance(tree, int):
        return leaves[tree]
    return tree if isinstance(tree, float) else (tree[0], tree[1], _filled(tree[2], leaves), _filled(tree[3], leaves))


def _best_split(sums: dict) -> tuple | None:
    """(gain, feature, value) of a node from its (feature, value) -> (g, h) sums."""
    best = None
    for at in range(len(FEATURES)):
        values = sorted(v for f, v in sums if f == at)
        g_all, h_all = (sum(sums[at, v][k] for v in values) for k in (0, 1))
        g = h = 0.0
        for v in values[:-1]:
            g, h = g + sums[at, v][0], h + sums[at, v][1]
            if min(h, h_all - h) * 4 < LEAST_WEIGHT:
                continue
            gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all * g_all / (h_all + RIDGE)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = (gain, at, v)
    return best


def boost(examples: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> tuple[float, list]:
    """(start score, trees) from (features, y, w): second-order boosting of the logistic loss.

    A level is one aggregate of gradient and Hessian sums by (node, feature, value); only these sums reach the driver.
    """
    total = examples.agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")).first()
    n, pos = float(total["n"] or 0), float(total["pos"] or 0)
    if pos == 0 or pos == n:
        return (4.0 if n and pos == n else -4.0), []
    start, trees = log(pos / (n - pos)), []
    state = cut_lineage(examples.withColumn("margin", F.lit(start)))
    for _ in range(rounds):
        tree, next_open = 0, [0]
        for level in range(depth + 1):
            node = _node_number(tree, F.col("features"))
            p = 1 / (1 + F.exp(-F.col("margin")))
            rows = state.select(node.alias("node"), F.posexplode("features").alias("f", "v"), (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"))
            sums: dict = {}
            for r in rows.where("node >= 0").groupBy("node", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums.setdefault(r["node"], {})[r["f"], r["v"]] = (r["g"], r["h"])
            closed, following = {}, []
            for k in next_open:
                own = sums[k]
                split = _best_split(own) if level < depth else None
                if split is None:
                    g, h = (sum(s[i] for (f, _), s in own.items() if f == 0) for i in (0, 1))
                    closed[k] = float(-STEP * g / (h + RIDGE))
                else:
                    a = 2 * k + 1
                    closed[k] = (split[1], split[2], a, a + 1)
                    following += [a, a + 1]
            tree, next_open = _filled(tree, closed | {k: k for k in following}), following
            if not following:
                break
        trees.append(tree)
        moved = cut_lineage(state.withColumn("margin", F.col("margin") + _tree_value(tree, F.col("features"))))
        drop_written(state)
        state = moved
    return start, trees


def fit_spans(proposed: DataFrame, sample: int = SAMPLE) -> SpanModel:
    """Trees and thresholds from candidates of ``propose``.

    Candidates that meet the base rule are true, those that overlap no base span are not; others teach nothing. The classifier learns from the
    ``sample`` candidates with the smallest hash (equal ones are counted once); a quarter of the others' hash range is held out for the thresholds: per kind the
    lowest score above which at least ``PRECISION`` of all held-out candidates are true. Without candidates nothing is added.
    """
    example = lambda c, y: F.struct(c["features"].alias("features"), y.alias("y"), c["first"].alias("first"), c["last"].alias("last"))
    true = F.transform("base", lambda c: example(c, F.lit(1)))
    false = F.transform(F.filter("other", lambda m: ~m["clash"]), lambda m: example(m["c"], F.lit(0)))
    rows = proposed.select("row", F.inline(F.concat(true, false))).withColumn("h", F.xxhash64("row", "first", "last", "features"))
    rows = cut_lineage(rows.select("features", "y", "h", (F.pmod("h", F.lit(4)) == 0).alias("held")))
    chosen = rows.where("NOT held").orderBy("h", "features", "y").limit(sample)
    start, trees = boost(chosen.groupBy("features", "y").agg(F.count("*").alias("w")).coalesce(1))
    model = SpanModel(start, trees, [])
    # all held-out candidates, counted by kind and score bin
    bin_ = F.floor(F.greatest(F.lit(-6.0), F.least(F.lit(5.999), model.margin(F.col("features")))) / 12 * SCORE_BINS).alias("bin")
    counts = rows.where("held").groupBy("features", "y").agg(F.count("*").alias("n")).groupBy(F.col("features")[0].alias("kind"), bin_).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("pos")
    )
    thresholds = [float("inf")] * 4
    by_kind: dict[int, list] = {}
    for r in counts.collect():  # at most four kinds of SCORE_BINS bins
        by_kind.setdefault(r["kind"], []).append((r["bin"], r["n"], r["pos"]))
    for kind, bins in by_kind.items():
        n = pos = 0
        for b, more, more_pos in sorted(bins, reverse=True):
            n, pos = n + more, pos + more_pos
            if pos >= PRECISION * n and more_pos:
                thresholds[kind] = b * 12 / SCORE_BINS
    return SpanModel(start, trees, thresholds)


# ---- selection ----


def _selected(marked: Column, model: SpanModel) -> Column:
    """Candidates that overlap no base span and reach their kind's threshold; of overlapping ones the better score, then the earlier."""
    limits = F.array(*[F.lit(t) for t in model.thresholds])
    scored = F.transform(F.filter(marked, lambda m: ~m["clash"]), lambda m: F.struct(m["c"]["first"].alias("first"), m["c"]["kind"].alias("kind"), m["c"]["last"].alias("last"), model.margin(m["c"]["features"]).alias("score")))
    good = F.filter(scored, lambda c: c["score"] >= limits[c["kind"]])
    span = "struct<first:bigint,kind:int,last:bigint,score:double>"

    def step(kept: Column, c: Column) -> Column:
        top = F.get(kept, F.size(kept) - 1)
        free = (F.size(kept) == 0) | (top["last"] <= c["first"])
        return F.when(free, F.concat(kept, F.array(c))).when(c["score"] > top["score"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(c))).otherwise(kept)

    return F.aggregate(good, F.array().cast(f"array<{span}>"), step)


def find_personal_data(reports: DataFrame, report: str = "report", carry: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The columns in ``carry`` (default all) and ``spans``: first, kind, last, base, score; by first, then kind as in ``KINDS``.

    Places are code points of the report, ``last`` exclusive. Spans with ``base`` meet a base rule: leftmost hits of its form that do not overlap
    within the kind and pass its test. The others were added by the trees: they overlap no base span and no other added one.

    Defined results: null and empty reports have no spans; reports of any length are read whole; rows that repeat get equal
    spans; without any candidate, or with candidates of one sort only, nothing is added; extra columns are carried, a column ``spans`` is replaced.
    """
    proposed = cut_lineage(propose(reports, report, carry))
    model = fit_spans(proposed, sample)
    return redact_with(proposed, model)


def redact_with(proposed: DataFrame, model: SpanModel) -> DataFrame:
    """``find_personal_data`` with a fitted model, over rows of ``propose``."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    base = F.transform("base", lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last"), F.lit(True).alias("base"), F.lit(None).cast("double").alias("score")))
    more = F.transform(
        _selected(F.col("other"), model),
        lambda c: F.struct(c["first"].alias("first"), c["kind"].alias("kind"), c["last"].alias("last"), F.lit(False).alias("base"), c["score"].alias("score")),
    )
    some = F.when(F.size("other") > 0, more).otherwise(F.array().cast("array<struct<first:bigint,kind:int,last:bigint,base:boolean,score:double>>"))
    spans = F.transform(
        F.array_sort(F.concat(base, some)),
        lambda c: F.struct(c["first"].alias("first"), name(c["kind"]).alias("kind"), c["last"].alias("last"), c["base"].alias("base"), c["score"].alias("score")),
    )
    return unpacked(proposed, spans=spans)


def redact(reports: DataFrame, report: str = "report", sample: int = SAMPLE) -> DataFrame:
    """All columns, with every span of ``find_personal_data`` in the report replaced by its kind in brackets."""
    found = find_personal_data(reports, report, None, sample)
    text = F.col(f"`{report}`")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(t: Column, s: Column) -> Column:
        fresh = s["first"] >= t["at"]
        gap = F.substr(text, (t["at"] + 1).cast("int"), (s["first"] - t["at"]).cast("int"))
        return F.struct(F.greatest(t["at"], s["last"]).alias("at"), F.when(fresh, F.concat(t["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(t["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda t: F.concat(t["out"], F.substr(text, (t["at"] + 1).cast("int"), F.length(text))))
    order = [F.col(f"`{c}`") for c in reports.columns if c.lower() != "spans"]
    return found.withColumn(report, clean).select(*order, "spans")
