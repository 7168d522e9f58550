"""Event encoders: text columns to numbers, fitted on training rows only."""

from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hosttrace.operators.clean import dash_to_null
from hosttrace.schema import BOOKKEEPING_DROP, IDENTITY_DROP

CATEGORY_LIMIT = 21  # fewer distinct values -> codes, otherwise text length (fixed value)
DROP = set(IDENTITY_DROP) | set(BOOKKEEPING_DROP)


def _numeric(field_):
    return isinstance(field_.dataType, (T.NumericType, T.BooleanType))


@dataclass
class EventEncoder:
    """Numbers stay, texts with few values become codes in sorted order, other texts become their length.

    NULL, unseen values and missing columns give -1. The fitted state is at most CATEGORY_LIMIT values per column.
    """

    limit: int = CATEGORY_LIMIT
    kinds: dict = field(default_factory=dict)
    codes: dict = field(default_factory=dict)

    def fit(self, df, first_seen_by=None):
        """One pass for the counts, one for exact distinct counts, one small query for the categorical columns' values.

        ``first_seen_by``: number the values by first appearance in that order instead of alphabetically.
        """
        df = dash_to_null(df)
        fields = [f for f in df.schema.fields if f.name not in DROP and not f.name.startswith("_")
                  and not isinstance(f.dataType, (T.TimestampType, T.DateType))]
        texts = [f.name for f in fields if not _numeric(f)]
        counts = df.agg(*[F.count(f.name).alias("n_" + f.name) for f in fields]).first()
        kept = [f for f in fields if counts["n_" + f.name] > 0]
        distinct = {}
        if texts:
            long = df.select(*texts).unpivot([], texts, "column", "value").where("value IS NOT NULL").distinct()
            distinct = {r["column"]: r["count"] for r in long.groupBy("column").count().collect()}
        few = [f.name for f in kept if not _numeric(f) and distinct[f.name] < self.limit]
        values = {}
        if few:
            order = F.col(first_seen_by) if first_seen_by else F.lit(0)
            long = df.select(order.alias("_o"), *few).unpivot("_o", few, "column", "value").where("value IS NOT NULL")
            for r in long.groupBy("column", "value").agg(F.min("_o").alias("_o")).collect():
                values.setdefault(r["column"], []).append((r["_o"], r["value"]))
        for f in kept:
            if _numeric(f):
                self.kinds[f.name] = "numeric"
            elif f.name in few:
                self.kinds[f.name] = "cat"
                self.codes[f.name] = {v: i for i, (_, v) in enumerate(sorted(values[f.name]))}
            else:
                self.kinds[f.name] = "strlen"
        return self

    def transform(self, df, keep=()):
        df = dash_to_null(df)

        def encoded(name, kind):
            if name not in df.columns:
                return F.lit(-1.0)
            c = F.col(name)
            if kind == "numeric":
                value = c.cast("double")
            elif kind == "strlen":
                value = F.length(c).cast("double")
            else:
                pairs = [F.lit(x) for v, i in self.codes[name].items() for x in (v, float(i))]
                value = F.try_element_at(F.create_map(*pairs), c)
            return F.coalesce(value, F.lit(-1.0))

        return df.select(*keep, *[encoded(n, k).alias(n) for n, k in self.kinds.items()])


def audit_encoding(df, features):
    """The audit's encoding: a has-value flag per column next to its code, length or number."""
    enc = EventEncoder().fit(df.select(*features))
    values = enc.transform(df, keep=[F.when(F.col(c).isNotNull(), 1).otherwise(0).alias(c + "__has")
                                     for c in features if c in enc.kinds])
    return values


def column_spread(df, columns):
    """(column, constant): whether a column has a single value, one row each."""
    one = df.agg(*[(F.min(c).eqNullSafe(F.max(c))).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "constant")


def constant_columns(df, columns):
    """Columns with a single value."""
    found = {r["column"] for r in column_spread(df, columns).where("constant").collect()}
    return [c for c in columns if c in found]


def require_varied(df, columns, most=0.30):
    """Raise when more than ``most`` of the columns are constant: a sign of a misread type."""
    constant = constant_columns(df, columns)
    if len(constant) > most * len(columns):
        raise ValueError(f"{len(constant)} of {len(columns)} features are constant: {', '.join(constant[:10])}")
    return constant


def standardise(train, others, columns):
    """Zero mean and unit population deviation from the training rows, applied to ``others``."""
    stats = train.agg(*[F.avg(c).alias("m_" + c) for c in columns],
                      *[F.stddev_pop(c).alias("s_" + c) for c in columns]).first()

    def scaled(c):
        sd = stats["s_" + c]
        return ((F.col(c) - F.lit(stats["m_" + c])) / F.lit(sd if sd else 1.0)).alias(c)

    return [df.select(*[scaled(c) if c in columns else F.col(c) for c in df.columns]) for df in others]
