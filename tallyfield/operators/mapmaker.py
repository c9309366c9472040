"""Map making: signals and preconditioners as linear operators on tables, solved by conjugate gradients.

A signal turns its parameters (idx..., value) into samples (`forward`) and samples into parameters (`backward`, the transpose). The equation
system sums P' W P over signals, plus epsilon times the parameters, plus what other priors (functions of the parameters)
give. Its vectors are tables, dot products are joins, and each step's tables are
written before the next, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


class Signal(Protocol):
    name: str

    def forward(self, params: DataFrame, samples: DataFrame) -> DataFrame: ...

    def backward(self, samples: DataFrame) -> DataFrame: ...


@dataclass
class Binned:
    """One parameter per value of `cell` (pixel, azimuth bin, range of a cut, detector): sum of value * weight column."""

    name: str
    cell: list[str]
    factor: str | None = None

    def _f(self) -> Column:
        return F.col(self.factor) if self.factor else F.lit(1.0)

    def _index(self) -> Column:
        return F.concat_ws(":", F.lit(self.name), *[F.col(c).cast("string") for c in self.cell]).alias("idx")

    def backward(self, samples: DataFrame) -> DataFrame:
        """samples with `r`: idx, value."""
        return samples.groupBy(self._index()).agg(F.sum(F.col("r") * self._f()).alias("value"))

    def forward(self, params: DataFrame, samples: DataFrame) -> DataFrame:
        """samples with `m`, the model at each sample, added to."""
        own = samples.withColumn("idx", self._index())
        return own.join(params.select("idx", F.col("value").alias("_p")), "idx", "left").withColumn("m", F.col("m") + F.coalesce(F.col("_p") * self._f(), F.lit(0.0))).drop("_p", "idx")

    def diagonal(self, samples: DataFrame) -> DataFrame:
        """Preconditioner: sum of weight * factor^2 per parameter."""
        return samples.groupBy(self._index()).agg(F.sum(F.col("w") * self._f() * self._f()).alias("d"))

    def hits(self, samples: DataFrame) -> DataFrame:
        return samples.groupBy(self._index()).agg(F.count(F.lit(1)).cast("double").alias("d"))


@dataclass
class Spread:
    """Samples that see several parameters at once: `cells` is an array of structs of the fields in `cell` and a response `f`, one for
    each beam or neighbour that a sample looks at (side beams with responses of their own, linear pointing, a cell that moves
    with time); key names the samples."""

    name: str
    key: list[str]
    cells: Column
    cell: list[str]

    def _seen(self, samples: DataFrame, *columns: Column) -> DataFrame:
        rows = samples.select(*self.key, *columns, F.explode(self.cells).alias("_s"))
        index = F.concat_ws(":", F.lit(self.name), *[F.col(f"_s.{c}").cast("string") for c in self.cell]).alias("idx")
        return rows.withColumns({"idx": index, "_f": F.col("_s.f").cast("double")}).drop("_s")

    def backward(self, samples: DataFrame) -> DataFrame:
        return self._seen(samples, F.col("r")).groupBy("idx").agg(F.sum(F.col("r") * F.col("_f")).alias("value"))

    def forward(self, params: DataFrame, samples: DataFrame) -> DataFrame:
        met = self._seen(samples).join(params.select("idx", F.col("value").alias("_p")), "idx")
        sums = met.groupBy(*self.key).agg(F.sum(F.col("_p") * F.col("_f")).alias("_p"))
        return samples.join(sums, self.key, "left").withColumn("m", F.col("m") + F.coalesce("_p", F.lit(0.0))).drop("_p")

    def diagonal(self, samples: DataFrame) -> DataFrame:
        """Of each parameter's own responses; a sample that sees one parameter twice has the sum of both."""
        own = self._seen(samples, F.col("w")).groupBy(*self.key, "idx").agg(F.first("w").alias("w"), F.sum("_f").alias("_f"))
        return own.groupBy("idx").agg(F.sum(F.col("w") * F.col("_f") * F.col("_f")).alias("d"))


def template(name: str, column: str) -> Binned:
    """One amplitude of a fixed template."""
    return Binned(name, [], column)


def gains(name: str, model: str) -> Binned:
    """A gain per detector against a model column."""
    return Binned(name, ["det"], model)


def unconditioned(r: DataFrame) -> DataFrame:
    """No preconditioner."""
    return r


def no_prior(x: DataFrame) -> DataFrame:
    return x.select("idx", F.lit(0.0).alias("value"))


@dataclass
class Equations:
    """A x = P' W d with A = P' W P + epsilon + priors; samples have value d and weight w. A prior turns parameters (idx, value)
    into (idx, value) and has to be symmetric and not negative. With `noise`, a function that multiplies the samples' column `r`
    by an inverse covariance of theirs (such as those of noisemodels), W is w^1/2 N^-1 w^1/2."""

    samples: DataFrame
    signals: list[Binned]
    epsilon: float = 0.0
    priors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    trace: list[float] = field(default_factory=list)
    noise: Callable[[DataFrame], DataFrame] | None = None

    def weighted(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with `r`, the weight matrix times a column."""
        if self.noise is None:
            return rows.withColumn("r", F.col("w") * F.col(column))
        return self.noise(rows.withColumn("r", F.sqrt("w") * F.col(column))).withColumn("r", F.sqrt("w") * F.col("r"))

    def condensed(self) -> Equations:
        """The same equations from fewer samples: without noise between samples, those that no signal tells apart add their weights
        and take the weighted mean of their values."""
        if self.noise is not None or not all(isinstance(s, Binned) for s in self.signals):
            return self
        seen = list(dict.fromkeys(c for s in self.signals for c in (*s.cell, *([s.factor] if s.factor else []))))
        sums = self.samples.groupBy(*seen).agg(F.sum("w").cast("double").alias("w"), F.sum(F.col("w") * F.col("value")).cast("double").alias("_r"))
        rows = cut(sums.select(*seen, "w", F.try_divide("_r", "w").alias("value")))
        return replace(self, samples=rows, trace=[])

    def rhs(self) -> DataFrame:
        own = self.weighted(self.samples, "value")
        return reduce(DataFrame.unionByName, [s.backward(own) for s in self.signals])

    def apply(self, x: DataFrame) -> DataFrame:
        rows = reduce(lambda df, s: s.forward(x, df), self.signals, self.samples.withColumn("m", F.lit(0.0)))
        rows = self.weighted(rows, "m")
        out = reduce(DataFrame.unionByName, [s.backward(rows) for s in self.signals])
        if self.priors:
            out = reduce(DataFrame.unionByName, [p(x).select("idx", "value") for p in self.priors], out).groupBy("idx").agg(F.sum("value").alias("value"))
        if not self.epsilon:
            return out
        return out.join(x.select("idx", F.col("value").alias("_x")), "idx").select("idx", (F.col("value") + self.epsilon * F.col("_x")).alias("value"))

    def diagonal(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [s.diagonal(self.samples) for s in self.signals])

    @staticmethod
    def dot(a: DataFrame, b: DataFrame) -> float:
        return a.join(b.select("idx", F.col("value").alias("_b")), "idx").agg(F.sum(F.col("value") * F.col("_b"))).first()[0] or 0.0

    @staticmethod
    def axpy(a: DataFrame, k: float, b: DataFrame) -> DataFrame:
        return a.join(b.select("idx", F.col("value").alias("_b")), "idx").select("idx", (F.col("value") + k * F.col("_b")).alias("value"))

    def around(self, places: DataFrame) -> DataFrame:
        """The system's columns of some parameters (idx) added up: how the inverse covariance of the solution looks around them. Places
        that are far enough apart don't meet."""
        at = self.diagonal().select("idx").join(places.select("idx").distinct().withColumn("value", F.lit(1.0)), "idx", "left")
        return self.apply(at.select("idx", F.coalesce("value", F.lit(0.0)).alias("value")))

    def write_diagonals(self, path: str) -> None:
        """What preconditions each signal, and its hits where it counts them, as Parquet by signal."""
        for s in self.signals:
            own = s.diagonal(self.samples)
            if hasattr(s, "hits"):
                own = own.join(s.hits(self.samples).select("idx", F.col("d").alias("hits")), "idx", "left")
            own.write.mode("overwrite").parquet(f"{path}/{s.name}")

    def through_samples(self, covariance: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """A preconditioner for correlated noise: (P' P)^-1 P' w^-1/2 N w^-1/2 P (P' P)^-1, where covariance multiplies the samples'
        column `r` by N, scan by scan. It is the inverse system where each parameter is seen by scans of its own."""
        plain = Equations(self.samples.withColumn("w", F.lit(1.0)), self.signals)
        inverse = cut(plain.diagonal().select("idx", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0).alias("i")))
        scale = lambda v: v.join(inverse, "idx").select("idx", (F.col("value") * F.col("i")).alias("value"))

        def apply(r: DataFrame) -> DataFrame:
            x = scale(r)
            rows = reduce(lambda df, s: s.forward(x, df), self.signals, self.samples.withColumn("m", F.lit(0.0)))
            root = F.coalesce(F.try_divide(F.lit(1.0), F.sqrt("w")), F.lit(0.0))
            rows = covariance(rows.withColumn("r", F.col("m") * root)).withColumn("r", F.col("r") * root)
            return scale(reduce(DataFrame.unionByName, [s.backward(rows) for s in self.signals]))

        return apply

    def solve(self, steps: int = 20, enough: float = 1e-10, watch: Callable[[int, float], None] | None = None, precondition: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """idx, value. Relative errors of the steps are left in `trace`. The diagonal preconditions, if nothing else is given."""
        own = self.condensed()
        inverse = cut(own.diagonal().select("idx", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(0.0).alias("i")))
        scale = precondition or (lambda v: v.join(inverse, "idx").select("idx", (F.col("value") * F.col("i")).alias("value")))
        r = cut(own.rhs())
        x = r.select("idx", F.lit(0.0).alias("value"))
        z = cut(scale(r))
        p, rz = z, self.dot(r, z)
        first = rz
        for k in range(steps):
            if first == 0 or rz / first < enough:
                break
            ap = cut(own.apply(p))
            size = self.dot(p, ap)
            if size <= 0:
                raise ValueError("the equations are singular: no sample, prior or epsilon holds some parameters")
            alpha = rz / size
            x, r = cut(self.axpy(x, alpha, p)), cut(self.axpy(r, -alpha, ap))
            z = cut(scale(r))
            new = self.dot(r, z)
            p, rz = cut(self.axpy(z, new / rz, p)), new
            self.trace.append(rz / first)
            if watch:
                watch(k, rz / first)
        return x
