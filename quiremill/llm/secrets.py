"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. From it follows a Boolean query over trigrams of the lower-cased
text: an OR of sets of trigrams that every match must hold. The index lists, for each trigram that
some rule needs, the rows that hold it (postings); a row is a candidate for a rule if the postings
of all trigrams of one of its sets meet there. Only candidates are verified with the expression
itself. A rule without mandatory trigrams (``hex``) is verified on every row.

Matches are leftmost and non-overlapping for each kind; those whose measured part is shorter than
the rule asks for are dropped afterwards, so they still use up their characters. Where a shorter
match only lies in the stretch of characters that a long enough one would need (``hex``), the length
is part of what is scanned for, with the same result. Positions count code points, the end is exclusive.

Only candidates' texts are shuffled, behind a bitmap of fixed size; a rule that scans every row does so
where the row is. Spans of a text with many matches are placed in stretches of ``STRETCH`` matches, so the
work grows with their number.

Defined cases: a null text counts as empty and has no spans; rows are told apart by id and text, so
repeated rows get equal results and ids may repeat or be null; extra columns pass through unread,
but one named like an output column (``found``) is an error before any job runs. An empty table gives
an empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quiremill.llm.io import fresh, maybe_in, saved

STRETCH = 256


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches count if group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: The expression with the least length in it, where the matches that are long enough are the same.
    scan: str = ""


#: The first three are the base rules; the order is that of kinds with the same start.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]+", 0, 16),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)
BASE = 3


def _extend(options: set[tuple[frozenset, str]], letters: list[str]) -> set[tuple[frozenset, str]]:
    out = set()
    for grams, tail in options:
        for c in letters:
            now = tail + c
            out.add((grams | {now} if len(now) == 3 else grams, now[-2:]))
    return out


def _walk(items, options: set[tuple[frozenset, str]]) -> set[tuple[frozenset, str]]:  # noqa: ANN001
    """Follow the parsed expression; an option is (trigrams so far, last two characters, if they are known)."""
    for op, arg in items:
        if op is sre.LITERAL:
            options = _extend(options, [chr(arg).lower()])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len({chr(a).lower() for _, a in arg}) <= 4:
            options = _extend(options, sorted({chr(a).lower() for _, a in arg}))
        elif op is sre.SUBPATTERN:
            options = _walk(arg[3], options)
        elif op is sre.BRANCH:
            options = set().union(*(_walk(branch, options) for branch in arg[1]))
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            options = options | _walk(arg[2], options)
        elif op is sre.MAX_REPEAT and arg[0]:
            options = {(grams, "") for grams, _ in _walk(arg[2], options)}
        else:
            options = {(grams, "") for grams, _ in options}
        if len(options) > 256:
            options = {(grams, "") for grams, _ in options}
    return options


def trigram_query(pattern: str) -> list[frozenset] | None:
    """Sets of trigrams of which every match holds one whole set; None if a match may hold none."""
    found = {grams for grams, _ in _walk(parser.parse(pattern), {(frozenset(), "")})}
    if frozenset() in found:
        return None
    return sorted((g for g in found if not any(h < g for h in found)), key=sorted)


def candidates(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rid, rules): the indexed rules that each row of rows (rid, text) has to be verified for."""
    wanted = [(r.kind, i, gram, len(grams)) for r in rules for i, grams in enumerate(trigram_query(r.pattern) or []) for gram in sorted(grams)]
    grams = sorted({w[2] for w in wanted})
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams)))
    postings = rows.select("rid", F.lower("text").alias("low")).select("rid", F.explode(held).alias("gram"))
    asked = rows.sparkSession.createDataFrame(wanted, "kind string, part int, gram string, needed int")
    met = postings.join(F.broadcast(asked), "gram").groupBy("rid", "kind", "part", "needed").agg(F.count_distinct("gram").alias("n"))
    return met.where("n = needed").groupBy("rid").agg(F.collect_set("kind").alias("rules"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _matches(rule: Rule, text: Column) -> Column:
    """array<struct<start, end>> of the rule's matches that are long enough."""
    pattern = rule.scan or rule.pattern
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    parts = F.struct(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("n"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length).alias("g"),
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
    )

    def step(a: Column, m: Column) -> Column:
        start, end = a["at"] + m["gap"], a["at"] + m["gap"] + m["n"]
        return F.struct(end.alias("at"), F.when(m["g"] >= rule.least, F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out"))

    def stretches(p: Column) -> Column:
        """What each stretch of matches covers, and its spans counted from its own beginning."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(p["n"]) - 1) / STRETCH).cast("int"))

        def one(k: Column) -> Column:
            n, g, gap = (F.slice(p[x], k * STRETCH + 1, F.lit(STRETCH)) for x in ("n", "g", "gap"))
            each = F.zip_with(F.arrays_zip(n.alias("n"), g.alias("g")), F.slice(gap, F.lit(1), F.size(n)), lambda m, gap: F.struct(gap.alias("gap"), m["n"].alias("n"), m["g"].alias("g")))
            return F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

        return F.transform(numbers, one)

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

    def placed(made: Column) -> Column:
        bases = F.aggregate(made, begin, lambda a, s: F.struct((a["at"] + s["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(made, bases, lambda s, base: F.transform(s["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end")))))

    return F.when(text.rlike(pattern), _let(parts, lambda p: _let(stretches(p), placed))).otherwise(none)


def _named(no: int, kind: str):  # noqa: ANN202
    return lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end"), F.lit(kind).alias("kind"))


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with ``found``: array<struct<start, kind_no, end, kind>> of all kinds, in order of start and kind."""
    fresh(df, "found")
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    empty = F.expr("cast(array() as array<struct<start: int, kind_no: int, end: int, kind: string>>)")
    body, rid = F.coalesce(F.col(text), F.lit("")), F.xxhash64(F.lit(9), F.col(key), F.col(text))
    indexed = [(no, r) for no, r in enumerate(rules) if trigram_query(r.pattern) is not None]
    others = [(no, r) for no, r in enumerate(rules) if trigram_query(r.pattern) is None]
    rows = df.select(rid.alias("rid"), body.alias("text"))
    verify = saved(candidates(rows, rules))
    some = maybe_in(rows, "rid", verify.select("rid")).join(verify, "rid")
    kinds = [F.transform(F.when(F.array_contains("rules", r.kind), _matches(r, F.col("text"))).otherwise(none), _named(no, r.kind)) for no, r in indexed]
    some = some.select(F.col("rid").alias("__rid"), reduce(F.concat, kinds, empty).alias("__some")).where("size(__some) > 0").groupBy("__rid").agg(F.first("__some").alias("__some"))
    own = df.withColumns({"__rid": rid, "__all": reduce(F.concat, [F.transform(_matches(r, body), _named(no, r.kind)) for no, r in others], empty)})
    found = F.array_sort(F.concat("__all", F.coalesce("__some", empty)))
    return own.join(some, "__rid", "left").select(*(F.col(f"`{c}`") for c in df.columns), found.alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of ``text`` replaced by mark (overlapping spans by one for each that begins after the last end)."""
    spans = find_spans(df, key, text)
    # The end of what is covered before each span; spans come in order of their starts.
    many, number = F.size("found"), F.expr(f"cast(floor((size(found) - 1) / {STRETCH}) as int)")
    parts = F.transform(F.sequence(F.lit(0), number), lambda k: F.slice("found", k * STRETCH + 1, F.lit(STRETCH)))

    def most(held: Column) -> Column:
        return F.aggregate(
            F.transform(held, lambda p: F.array_max(F.transform(p, lambda s: s["end"]))),
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
            lambda a, m: F.struct(F.greatest(a["at"], m).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def cleaned(p: Column, at: Column) -> Column:
        """What becomes of the text from ``at`` to the last end of a stretch of spans, cut out first: places are looked up from its beginning."""

        def replaced(body: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                piece = F.when(s["start"] >= a["at"], F.concat(F.substring(body, a["at"] - at + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["out"], piece).alias("out"))

            return F.array_join(F.aggregate(p, F.struct(at.alias("at"), F.expr("cast(array() as array<string>)").alias("out")), step, lambda a: a["out"]), "")

        return _let(F.substring(F.col(text), at + 1, F.array_max(F.transform(p, lambda s: s["end"])) - at), replaced)

    pieces = _let(parts, lambda held: F.zip_with(held, most(held), cleaned))
    rest = F.substring(F.col(text), F.array_max(F.transform("found", lambda s: s["end"])) + 1, F.length(text))
    clean = F.concat(F.array_join(pieces, ""), rest)
    return spans.withColumn(text, F.when(many > 0, clean).otherwise(F.col(text))).select(*(F.col(f"`{c}`") for c in df.columns))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL, every rule scanned in full: n_assign, n_access, n_hex, base_sha256 and spans of documents."""
    quoted = [r.pattern.replace("'", "''") for r in rules]
    arrays = ", ".join(f"regexp_extract_all(t, '{p}', 0) AS m{i}, regexp_extract_all(t, '{p}', {r.group}) AS g{i}, string_split_regex(t, '{p}') AS p{i}" for i, (r, p) in enumerate(zip(rules, quoted, strict=True)))
    lens = ", ".join(f"list_transform(m{i}, lambda x: length(x)) AS m{i}, list_transform(g{i}, lambda x: length(x)) AS g{i}, list_transform(p{i}, lambda x: length(x)) AS p{i}" for i in range(len(rules)))
    spans = ", ".join(
        f"list_filter(list_transform(range(1, len(m{i}) + 1), lambda k: {{'start': list_sum(p{i}[1:k]) + coalesce(list_sum(m{i}[1:k - 1]), 0), 'no': {i}, 'end': list_sum(p{i}[1:k]) + list_sum(m{i}[1:k]), 'kind': '{r.kind}', 'ok': g{i}[k] >= {r.least}}}), lambda s: s.ok) AS s{i}"
        for i, r in enumerate(rules)
    )
    every = "list_concat(" * (len(rules) - 1) + "s0" + "".join(f", s{i})" for i in range(1, len(rules)))
    say = "array_to_string(list_transform(list_sort({}), lambda s: s.kind || ':' || s.start::BIGINT || ':' || s.end::BIGINT), ',')"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, {arrays} FROM a),
c AS (SELECT doc_id, {lens} FROM b),
d AS (SELECT doc_id, {spans} FROM c)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex,
  sha256({say.format("list_concat(list_concat(s0, s1), s2)")}) AS base_sha256, {say.format(every)} AS spans
FROM d"""
