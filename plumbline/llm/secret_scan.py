"""Secrets in texts: three kinds found by pattern, and credentials linked from their parts.

A pattern alone can't tell a random 40-character token from a key. Such weak candidates
are reported only next to the parts that make them usable: identifiers, secrets and
endpoints are intervals of the text, and an interval join on (text, stretch of the text)
finds which of them lie within one scope. Everything is DataFrame expressions and joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.args import named_column
from plumbline.llm.common import free_names, written

# Fixed patterns of the base kinds, in their order.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

# Weak parts: reported only if complementary parts are near.
IDENTIFIER = r"\b(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16}\b"
RANDOM = r"(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+]{40}={0,2}(?![A-Za-z0-9/+=_-])"
ENDPOINT = r"""\b[a-z][a-z0-9+]{1,9}://[^\x00-\x20"'<>]+"""
# Weak parts told by their names, whatever their form: NAME=value, name: "value", a.name = value.
_NAMED = r"""(?i)(?<![A-Za-z0-9])(?:[a-z0-9]{{1,40}}[_.-]){{0,4}}(?:{})["']?\x20*[:=]\x20*["']?{}"""
NAME = _NAMED.format(
    r"(?:client|app|application|tenant|consumer|user|account|login)[_-]?(?:id|name)|user|login|account",
    r"[A-Za-z0-9@+_.-]{3,}",
)
VALUE = _NAMED.format(
    r"(?:secret|access|secret[_-]?access|account|client|private|signing|auth|consumer|storage)"
    r"[_-]?key|passphrase|pass|pwd",
    r"[A-Za-z0-9+/_.~!@#$%^&*=-]{8,}",
)
HOST = _NAMED.format(r"host(?:[_-]?name)?|server|endpoint", r"[A-Za-z0-9_.:-]{3,}")

KINDS = (
    "assign", "access", "hex", "identifier", "random", "endpoint", "name", "value", "host"
)
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


#: What a text must contain for any weak part to be reported.
_ANY_IDENTIFIER = rf"AKIA[A-Z0-9]{{16}}|\b(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{{16}}\b|{NAME}"


def _spans(text: Column, kind: str, pattern: str, least: int, group: int = 0) -> Column:
    """Spans of the pattern's matches, left to right, with ``least`` characters in a group.

    What lies between matches and the matches themselves give the positions, in code
    points, as running sums of their lengths.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    zipped = F.zip_with(
        F.zip_with(hits, measured, lambda h, m: F.struct(F.length(h).alias("n"), F.length(m).alias("m"))),
        F.slice(between, 1, F.size(hits)),
        lambda h, b: F.struct(
            F.length(b).cast("bigint").alias("gap"), h["n"].alias("n"), h["m"].alias("m")
        ),
    )
    number = F.lit(KINDS.index(kind))

    def step(done: Column, hit: Column) -> Column:
        start = done["at"] + hit["gap"]
        span = F.struct(
            start.alias("start"), number.alias("kind"), (start + hit["n"]).alias("end")
        )
        grown = F.concat(done["spans"], F.array(span))
        return F.struct(
            (start + hit["n"]).alias("at"),
            F.when(hit["m"] >= least, grown).otherwise(done["spans"]).alias("spans"),
        )

    zero = F.lit(0).cast("bigint")

    def part(every: Column, chunk: Column) -> Column:
        return F.slice(every, (chunk * _CHUNK + 1).cast("int"), F.lit(_CHUNK))

    def in_chunks(every: Column) -> Column:
        # Adding to an array copies it, so spans grow in arrays of a bounded size only.
        last = F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / _CHUNK)
        chunks = F.sequence(F.lit(0).cast("bigint"), last)
        totals = F.transform(chunks, lambda chunk: F.aggregate(
            part(every, chunk), zero, lambda at, hit: at + hit["gap"] + hit["n"]))
        return _once(totals, lambda totals_: F.flatten(F.transform(chunks, lambda chunk: F.aggregate(
            part(every, chunk),
            F.struct(
                F.aggregate(F.slice(totals_, F.lit(1), chunk.cast("int")), zero, lambda a, b: a + b).alias("at"),
                _none().alias("spans"),
            ),
            step, lambda done: done["spans"]))))

    return _once(zipped, in_chunks)


#: Matches whose spans are put together in one array before the arrays are joined.
_CHUNK = 256


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _where(text: Column, test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(_none())


def _base_spans(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            _where(text, text.rlike(ASSIGN), _spans(text, "assign", ASSIGN, ASSIGN_VALUE, 2)),
            _where(text, text.contains("AKIA"), _spans(text, "access", ACCESS, ACCESS_LENGTH)),
            # A run of at least the length, matched as such, is the whole run.
            _where(
                text,
                text.rlike(f"[0-9a-f]{{{HEX_LENGTH}}}"),
                _spans(text, "hex", f"[0-9a-f]{{{HEX_LENGTH},}}", HEX_LENGTH),
            ),
        )
    )


def _weak_spans(text: Column) -> Column:
    weak = F.concat(
        _spans(text, "identifier", IDENTIFIER, 1),
        _spans(text, "random", RANDOM, 1),
        _spans(text, "endpoint", ENDPOINT, 1),
        _spans(text, "name", NAME, 1),
        _spans(text, "value", VALUE, 1),
        _spans(text, "host", HOST, 1),
    )
    return F.when(text.rlike(_ANY_IDENTIFIER), weak).otherwise(_none())


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """(key, linked) the weak spans of each text that have complementary parts in scope.

    A weak part is spread over the stretches of ``scope`` characters that it or its
    margins touch, a part it may be linked to over the stretches it lies in; equal
    stretches meet in the join. A stretch holds a bounded number of parts, since each is
    at least 6 characters long, so the join stays linear in the length of the text.
    """
    part = F.col("part")
    flat = parts.select("key", F.explode(F.concat("base", "weak")).alias("part")).select(
        "key", part["start"].alias("start"), part["kind"].alias("kind"), part["end"].alias("end")
    )
    kind = {name: F.lit(KINDS.index(name)) for name in KINDS}
    role = (
        F.when(F.col("kind").isin(kind["access"], kind["identifier"], kind["name"]), "identifier")
        .when(F.col("kind").isin(kind["endpoint"], kind["host"]), "endpoint")
        .otherwise("secret")
    )
    roled = flat.withColumn("role", role)
    wide = F.lit(scope)

    def stretch(position: Column) -> Column:
        return F.floor(position / wide)

    weak = roled.filter(F.col("kind") >= kind["identifier"]).withColumn(
        "stretch",
        F.explode(F.sequence(stretch(F.col("start") - wide), stretch(F.col("end") + wide))),
    )
    other = roled.filter(F.col("role") != "endpoint").select(
        "key",
        F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end")))).alias("stretch"),
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        F.col("role").alias("other_role"),
    )
    near = weak.join(other, ["key", "stretch"]).filter(
        (F.col("other_start") <= F.col("end") + wide)
        & (F.col("start") <= F.col("other_end") + wide)
        & (F.col("other_role") != F.col("role"))
    )
    found = near.groupBy("key", "start", "kind", "end").agg(
        F.bool_or(F.col("other_role") == "identifier").alias("identifier"),
        F.bool_or(F.col("other_role") == "secret").alias("secret"),
    )
    complete = (
        F.when(F.col("kind").isin(kind["identifier"], kind["name"]), F.col("secret"))
        .when(F.col("kind").isin(kind["random"], kind["value"]), F.col("identifier"))
        .otherwise(F.col("identifier") & F.col("secret"))
    )
    return (
        found.filter(complete)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    )


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200
) -> DataFrame:
    """(id, base, spans) for every row: arrays of (start, kind, end), kind an index of KINDS.

    Positions count code points, end exclusive. ``base`` has the matches of the three
    base patterns, leftmost and not overlapping within a kind. ``spans`` has these and
    the weak parts that overlap none of them and are linked within ``scope`` characters:
    an identifier (by form or by name) to a secret, a random token or a named value to an
    identifier, an endpoint or named host to both.
    Order is by start, then kind.

    Null and empty texts have no spans. Repeated rows stay rows: spans depend on the text
    alone, and texts with weak parts are joined to their links by SHA-256, each different
    text being linked once. An empty table gives none; other columns are not read. The
    spans of one text are one array, bounded by that text. Runs a job when called.
    """
    text = F.coalesce(named_column(text_col), F.lit(""))
    scanned = docs.select(named_column(id_col).alias("id"), text.alias("text")).select(
        "id",
        _base_spans(F.col("text")).alias("base"),
        _weak_spans(F.col("text")).alias("weak"),
        F.col("text"),
    )
    scanned = written(
        scanned.select(
            "id", "base", "weak", F.when(F.size("weak") > 0, F.sha2("text", 256)).alias("key")
        ),
        "spans",
    )
    candidates = scanned.filter(F.col("key").isNotNull())
    links = _linked(candidates.dropDuplicates(["key"]).select("key", "base", "weak"), scope)
    none = scanned.filter(F.col("key").isNull()).select("id", "base", F.col("base").alias("spans"))
    apart = F.filter(
        F.coalesce("linked", _none()),
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    some = candidates.join(links, "key", "left").select(
        "id", "base", F.array_sort(F.concat("base", apart)).alias("spans")
    )
    return none.unionByName(some)


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, of an array of spans."""
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every stretch that spans cover, overlapping or not, as one mark."""
    step = lambda done, s: F.when(
        s["start"] >= done["at"],
        F.struct(
            F.array_append(
                done["kept"], F.substring(text, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
            ).alias("kept"),
            s["end"].alias("at"),
        ),
    ).otherwise(F.struct(done["kept"].alias("kept"), F.greatest(done["at"], s["end"]).alias("at")))
    first = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).cast("bigint").alias("at"))
    whole = F.length(text)
    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans, first, step,
            lambda done: F.array_join(
                F.array_append(
                    done["kept"], F.substring(text, (done["at"] + 1).cast("int"), whole)
                ),
                mark,
            ),
        )
    )


def redact_secrets(
    docs: DataFrame, text_col: str = "text", scope: int = 200, mark: str = "[secret]"
) -> DataFrame:
    """``docs`` with every span of :func:`secret_spans` in its text replaced by ``mark``.

    Other columns and the number of rows stay; a null text stays null.
    """
    text = F.coalesce(named_column(text_col), F.lit(""))
    weak = text.rlike(_ANY_IDENTIFIER)
    base, others, key, found = free_names(docs, "base", "weak", "key", "linked")
    candidates = docs.filter(weak).withColumns(
        {base: _base_spans(text), others: _weak_spans(text), key: F.sha2(text, 256)}
    )
    parts = candidates.select(
        F.col(base).alias("base"), F.col(others).alias("weak"), F.col(key).alias("key")
    ).dropDuplicates(["key"])
    links = _linked(written(parts, "spans"), scope).select(
        F.col("key").alias(key), F.col("linked").alias(found)
    )
    some = candidates.join(links, key, "left").withColumn(
        text_col,
        redacted(
            named_column(text_col),
            F.array_sort(F.concat(base, F.coalesce(found, _none()))),
            mark,
        ),
    )
    none = docs.filter(~weak).withColumn(base, _base_spans(text)).withColumn(
        text_col, redacted(named_column(text_col), F.col(base), mark)
    )
    kept = [named_column(name) for name in docs.columns]
    return none.select(*kept).unionByName(some.select(*kept))
