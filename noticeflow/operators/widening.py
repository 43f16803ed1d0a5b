"""Union of tables whose columns have drifted in type: the narrowest type that holds what both have, and nothing unread is lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.columns import unused
from noticeflow.functions.dates import parse_date
from noticeflow.operators.merge import union_all

#: Whole numbers by width; each is within the next.
_WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type above two: of two numbers the wider one, of a date and a time the time, of a text and another type that type.

    A text says what an older generation wrote by hand, so the typed column stands and texts are read into it. Types that have nothing in
    common, such as a number and a date, meet in text. The order of the two, and of more, does not matter but for texts, which count last.
    """
    if a == b:
        return a
    if {type(a), type(b)} & {T.FloatType, T.DoubleType} and isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.NullType):
            return y
        if x in _WHOLE and y in _WHOLE:
            return _WHOLE[max(_WHOLE.index(x), _WHOLE.index(y))]
        if isinstance(x, T.DecimalType) and isinstance(y, T.NumericType):
            digits = y.precision - y.scale if isinstance(y, T.DecimalType) else 19
            scale = max(x.scale, y.scale if isinstance(y, T.DecimalType) else 0)
            return T.DecimalType(min(38, max(x.precision - x.scale, digits) + scale), scale)
        if isinstance(x, T.DateType) and isinstance(y, (T.TimestampType, T.TimestampNTZType)):
            return y
    return T.StringType()


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Of typed columns the least type above all; text where there are only texts, or where they have nothing in common."""
    typed = [t for t in types if not isinstance(t, (T.StringType, T.NullType))]
    out: T.DataType = T.NullType() if not typed and not any(isinstance(t, T.StringType) for t in types) else (typed[0] if typed else T.StringType())
    for t in typed[1:]:
        out = wider(out, t)
    return out


def read_as(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """The value as another type, null where it can't be read; dates also in the forms that notices have."""
    if isinstance(have, T.StringType) and isinstance(want, T.DateType):
        return F.coalesce(value.try_cast(want), parse_date(value))
    if isinstance(have, T.StringType) and want in _WHOLE:
        return F.when(value.try_cast(T.DecimalType(38, 10)) == value.try_cast(want), value.try_cast(want))
    if isinstance(have, T.StringType) and isinstance(want, T.BooleanType):
        return F.when(F.lower(F.trim(value)).isin("true", "false"), value.try_cast(want))
    if isinstance(have, T.StringType) and isinstance(want, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(value, want)
    if isinstance(want, T.StringType) and isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.try_cast(want)


def union_widened(frames: Sequence[DataFrame], unread: str = "unread") -> DataFrame:
    """All rows of the frames, columns by name, each of the least type that holds it everywhere; missing columns are null.

    ``unread`` is a map from column to text of the values that could not be read as that type (which are null there), null where all could. A null is no unread value. No frame has a
    column of that name.
    """
    if any(unused(f.columns, unread) != [unread] for f in frames):
        raise ValueError(f"a frame has a column {unread}")
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    want = {n: common_type([f.schema[n].dataType for f in frames if n in f.columns]) for n in names}

    def one(f: DataFrame) -> DataFrame:
        changed = [c for c in f.columns if f.schema[c].dataType != want[c]]
        new = {c: read_as(F.col(c), f.schema[c].dataType, want[c]) for c in changed}
        lost = F.array(*[F.struct(F.lit(c).alias("k"), F.when(F.col(c).isNotNull() & new[c].isNull(), F.col(c).cast("string")).alias("v")) for c in changed])
        entries = F.filter(lost, lambda e: e["v"].isNotNull()) if changed else None
        left = F.when(F.size(entries) > 0, F.map_from_entries(entries)) if changed else F.lit(None).cast("map<string,string>")
        return f.select(*[new[c].alias(c) if c in new else F.col(c) for c in f.columns], left.alias(unread))

    return union_all([one(f) for f in frames]).select(*names, unread)
