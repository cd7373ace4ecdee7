"""Personal data: candidates of wide patterns, judged by boosted trees. DataFrame functions only.

Strict patterns give base spans, which always stay. For each kind a wide generator proposes what looks like it (other
separators, a spelled-out "at", no country code, a failed check digit), and proposals of several kinds may overlap. Every
candidate has a few small features of its format and context; what the strict rule alone decides (the plus sign, the check
digit, the separators) is kept from them. A candidate that meets its strict rule is a positive example. Boosted trees so learn
how likely something of that look and place is personal data, and a near miss that looks like what nearly always is gets redacted.

All candidates of the corpus are counted by feature cell and fold, and boosting works on these counts: at most CELLS cells,
whatever the size of the corpus, come to the driver. Trees are fitted on one fold and thresholds set on the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns, written so that no character is read again after a failed try.
STRICT = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WIDE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?@\x20?|\x20?[\[(](?i:at)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)*+",
    r"(?<![0-9])[0-9]++(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]++){3}",
    r"[0-9](?:[\x20._/-]{0,2}[0-9])++",
    r"(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,3}[0-9])++",
)
NEEDS = (r"@|[\[(](?i:at)[\])]", "[0-9]", "[0-9]", "[0-9]")  # a text without it has no candidate of the kind
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CUES = (r"e-?mail|contact|write to|reach|@", r"\bip\b|host|server|addr", r"card|visa|amex|credit|payment", r"phone|\btel|call|fax|mobile|\bcell")
#: Features and how many values each has; kind comes first.
FEATURES = {"kind": 4, "size": 20, "groups": 6, "bracket": 2, "left": 6, "right": 6, "cue": 3}
CELLS = 2 * int(np.prod(list(FEATURES.values())))
GROUP = 512  # spans whose places are added up together
BASE = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(text: Column, pattern: str, reach: int = 32) -> Column:
    """array<struct<start, end, text, left, right>> of the pattern's leftmost matches: left are up to `reach` characters before it,
    right one after it, both up to the next match. Places are summed up GROUP by GROUP, so long texts aren't copied match by match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:int,end:int,text:string,left:string,right:string>>"

    def cut(parts: Column) -> Column:
        n = F.size(parts["m"])
        rows = F.arrays_zip(F.slice(parts["g"], 1, n).alias("g"), parts["m"].alias("m"), F.slice(parts["g"], 2, n).alias("r"))
        return F.transform(rows, lambda x: F.struct(F.char_length(x["g"]).alias("gap"), F.right(x["g"], F.lit(reach)).alias("left"), x["m"].alias("text"), F.substring(x["r"], 1, 1).alias("right")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.char_length(x["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["left"].alias("left"), x["right"].alias("right")))).alias("out"))

    def grouped(rows: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / GROUP).cast("int")), lambda k: F.aggregate(F.slice(rows, k * GROUP + 1, F.lit(GROUP)), zero, step))

    def joined(groups: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("heads"))
        heads = F.aggregate(groups, zero, lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["heads"], F.array(acc["at"])).alias("heads")), lambda acc: acc["heads"])
        moved = lambda g, h: F.transform(g["out"], lambda s: F.struct((s["start"] + h).alias("start"), (s["end"] + h).alias("end"), s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right")))
        return _let(heads, lambda hs: F.flatten(F.zip_with(groups, hs, moved)))

    parts = F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g"))
    return _let(parts, lambda p: _let(cut(p), lambda rows: _let(grouped(rows), joined)))


def _digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[0-9]"))


def _strict(kind: int, text: Column) -> Column:
    """Whether a match of the kind's strict pattern holds."""
    if kind == 1:
        return F.rlike(text, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == 2:
        return _digits(text).between(12, 19) & X.luhn_ok(X.digits(text))
    return _digits(text).between(9, 15) if kind == 3 else F.lit(True)


def _if_any(text: Column, kind: int, spans: Column, schema: str) -> Column:
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), spans).otherwise(F.array().cast(schema))


def base_spans(text: Column) -> Column:
    """The strict spans of all kinds, ordered by start, kind and end."""

    def of(kind: int) -> Column:
        held = F.filter(places(text, STRICT[kind]), lambda s: _strict(kind, s["text"]))
        return _if_any(text, kind, F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))), BASE)

    return F.array_sort(F.concat(*map(of, range(len(KINDS)))))


def _side(c: Column) -> Column:
    """What a neighbouring character is: 0 none or a line end, 1 blank, 2 punctuation, 3 letter, 4 digit, 5 other."""
    return F.when(F.coalesce(c, F.lit("")).isin("", "\n", "\r"), 0).when(c.isin(" ", "\t"), 1).when(F.rlike(c, F.lit(r"[\"'.,;:!?()<>\[\]]")), 2).when(F.rlike(c, F.lit(r"\p{L}|_")), 3).when(F.rlike(c, F.lit("[0-9]")), 4).otherwise(5)


def candidates(text: Column) -> Column:
    """All candidates: start, end, the features, sure (it meets its strict rule), fold."""
    schema = "array<struct<start:int,end:int," + ",".join(f"{f}:int" for f in FEATURES) + ",sure:boolean,fold:int>>"

    def of(kind: int) -> Column:
        size = (lambda t: F.char_length(F.regexp_extract(t, r"[A-Za-z0-9]*$", 0))) if kind == 0 else _digits
        groups = r"\.|(?i:dot)" if kind == 0 else "[0-9]+"
        least, most = {2: (12, 19), 3: (7, 15)}.get(kind, (None, None))
        others = "|".join(c for j, c in enumerate(CUES) if j != kind)

        def made(s: Column) -> Column:
            t, low = s["text"], F.lower(s["left"])
            values = {
                "kind": F.lit(kind),
                "size": F.least(size(t), F.lit(FEATURES["size"] - 1)),
                "groups": F.least(F.regexp_count(t, F.lit(groups)), F.lit(FEATURES["groups"] - 1)),
                "bracket": F.contains(t, F.lit("(")).cast("int") if kind == 3 else F.lit(0),
                "left": _side(F.right(s["left"], F.lit(1))),
                "right": _side(s["right"]),
                "cue": F.when(F.rlike(low, F.lit(CUES[kind])), 1).when(F.rlike(low, F.lit(others)), 2).otherwise(0),
            }
            sure = F.rlike(t, F.lit(f"^(?:{STRICT[kind]})$")) & _strict(kind, t)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), *[v.cast("int").alias(f) for f, v in values.items()], sure.alias("sure"), F.pmod(F.xxhash64(t), F.lit(2)).cast("int").alias("fold"))

        found = places(text, WIDE[kind])
        found = found if least is None else F.filter(found, lambda s: _digits(s["text"]).between(least, most))
        return _if_any(text, kind, F.transform(found, made), schema)

    return F.concat(*map(of, range(len(KINDS))))


@dataclass
class Tree:
    """A split (feature at most value: left, else right) or, without a feature, a weight."""

    weight: float = 0.0
    feature: int | None = None
    value: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.weight) if self.feature is None else np.where(x[:, self.feature] <= self.value, self.left.of(x), self.right.of(x))

    def column(self, c: Column) -> Column:
        return F.lit(self.weight) if self.feature is None else F.when(c[list(FEATURES)[self.feature]] <= self.value, self.left.column(c)).otherwise(self.right.column(c))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, smooth: float) -> Tree:
    """A regression tree on gradients g and weights h of cells x, each split the one that gains most."""
    gain = lambda a, b: a * a / (b + smooth)
    whole, best = gain(g.sum(), h.sum()), (1e-6, None, 0)
    for f, n in enumerate(FEATURES.values()) if depth else ():
        a, b = np.cumsum(np.bincount(x[:, f], g, n)), np.cumsum(np.bincount(x[:, f], h, n))
        gains = gain(a[:-1], b[:-1]) + gain(a[-1] - a[:-1], b[-1] - b[:-1]) - whole
        at = int(gains.argmax())
        if gains[at] > best[0] and 0 < b[at] < b[-1]:
            best = (float(gains[at]), f, at)
    if best[1] is None:
        return Tree(weight=round(float(rate * g.sum() / (h.sum() + smooth)), 9))
    low = x[:, best[1]] <= best[2]
    grown = [_grow(x[s], g[s], h[s], depth - 1, rate, smooth) for s in (low, ~low)]
    return Tree(feature=best[1], value=best[2], left=grown[0], right=grown[1])


@dataclass
class Model:
    """Trees, and for each kind the least score to redact (none: nothing is added)."""

    start: float
    trees: list[Tree]
    least: dict[int, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.of(x) for t in self.trees), np.zeros(len(x)))

    def column(self, c: Column) -> Column:
        out = F.lit(self.start)
        for t in self.trees:
            out = out + t.column(c)
        return out

    def takes(self, c: Column, score: Column) -> Column:
        floor = F.lit(float("inf"))
        for kind, least in self.least.items():
            floor = F.when(c["kind"] == kind, least).otherwise(floor)
        return score >= floor


def _wilson(y: float, n: float, z: float) -> float:
    """Lower bound of a share of y in n."""
    p = y / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(cells: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, smooth: float = 1.0, precision: float = 0.95, z: float = 1.645) -> Model:
    """Boosted trees for cells, whose rows are the features, fold, count, sure ones.

    Scores are calibrated in the fold the trees haven't seen: the share of sure candidates as a rising step function of the
    score. A kind's threshold is where the steps begin whose share is at least `precision` by its lower bound.
    """
    k = len(FEATURES)
    x, fold, n, y = cells[:, :k], cells[:, k], cells[:, k + 1].astype(float), cells[:, k + 2].astype(float)
    own = fold == 0
    xs, ns, ys = x[own], n[own], y[own]
    share = (ys.sum() + 1) / (ns.sum() + 2)
    model = Model(float(np.log(share / (1 - share))), [], {})
    at = np.full(len(xs), model.start)
    for _ in range(rounds if len(xs) else 0):
        p = 1 / (1 + np.exp(-at))
        model.trees.append(_grow(xs, ys - ns * p, ns * p * (1 - p), depth, rate, smooth))
        at += model.trees[-1].of(xs)
    scores = np.round(model.scores(x), 9)
    for kind in range(len(KINDS)):
        seen = (x[:, 0] == kind) & ~own
        levels, place = np.unique(scores[seen], return_inverse=True)
        steps: list[list[float]] = []  # least score, sure ones, all
        for level, a, b in zip(levels, np.bincount(place, y[seen], len(levels)), np.bincount(place, n[seen], len(levels)), strict=True):
            steps.append([level, a, b])
            while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
                _, a, b = steps.pop()
                steps[-1][1:] = steps[-1][1] + a, steps[-1][2] + b
        for level, a, b in reversed(steps):
            if _wilson(a, b, z) < precision:
                break
            model.least[kind] = float(level) - 1e-6
    return model


def learn(found: DataFrame) -> Model:
    """The model of all candidates in found (cands)."""
    each = found.select(F.explode("cands").alias("c")).select(*[f"c.{f}" for f in FEATURES], "c.fold", F.col("c.sure").cast("long").alias("sure"))
    cells = each.groupBy(*FEATURES, "fold").agg(F.count("*").alias("n"), F.sum("sure").alias("y")).orderBy(*FEATURES, "fold")
    return fit(np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, len(FEATURES) + 3))


def chosen(base: Column, cands: Column, model: Model) -> Column:
    """base and the candidates the model takes, ordered: of those, none overlaps a base span or a better one taken."""
    kind = "array<struct<start:int,added:int,end:int,kind:int,score:double>>"
    scored = F.transform(F.filter(cands, lambda c: ~c["sure"]), lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("added"), c["end"].alias("end"), c["kind"].alias("kind"), F.when(model.takes(c, model.column(c)), model.column(c)).alias("score")))
    taken = F.filter(scored, lambda c: c["score"].isNotNull())
    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("added"), b["end"].alias("end"), b["kind"].alias("kind"), F.lit(None).cast("double").alias("score")))

    def step(acc: Column, s: Column) -> Column:
        kept, reach = acc["kept"], acc["reach"]
        last = F.get(kept, F.size(kept) - 1)
        short = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        meets = F.coalesce(last["end"] > s["start"], F.lit(False))
        added = F.when(s["start"] < reach, kept).when(~meets, F.concat(kept, F.array(s))).when(s["score"] > last["score"], F.concat(short, F.array(s))).otherwise(kept)
        return F.struct(F.when(s["added"] == 0, F.greatest(reach, s["end"])).otherwise(reach).alias("reach"), F.when(s["added"] == 1, added).when(meets, short).otherwise(kept).alias("kept"))

    zero = F.struct(F.lit(0).alias("reach"), F.array().cast(kind).alias("kept"))
    swept = lambda more: F.aggregate(F.array_sort(F.concat(fixed, more)), zero, step, lambda acc: acc["kept"])
    plain = lambda kept: F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return _let(taken, lambda more: F.when(F.size(more) == 0, base).otherwise(F.array_sort(F.concat(base, plain(swept(more))))))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs as a struct `row`, with their base spans and candidates. Null texts have none."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), base_spans(text).alias("base"), candidates(text).alias("cands"))


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with base and spans: arrays of (start, kind, end) in code points, kind being a place in KINDS.

    A null text counts as empty. Repeated rows and null ids give rows as they come, an empty table none; other columns take no
    part and texts may be of any length. Texts are read once: spans and candidates are saved without them.
    """
    found = with_candidates(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    found = saved(found.select(F.col("row.id").alias(id_col), "base", "cands"), "personal")
    return found.select(id_col, "base", chosen(F.col("base"), F.col("cands"), learn(found)).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """personal_spans as id, n_email, n_ip, n_card, n_phone, base_sha256, spans ("kind:start:end", comma-joined)."""
    found = personal_spans(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the same rows and columns, each stretch of overlapping spans replaced by its first kind, as [EMAIL]. Null stays null."""
    model = learn(saved(with_candidates(docs.select(docs[text_col].alias("text"))).select("cands"), "personal"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    marked = with_candidates(docs, text_col).withColumn("spans", chosen(F.col("base"), F.col("cands"), model))
    text = F.col("row").getField(text_col)
    masked = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.char_length(text))))
    return marked.select(*[F.when(F.size("spans") > 0, masked).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
