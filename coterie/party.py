"""A party's table: which column is the id, which the label, which the features."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Role(str, Enum):
    ACTIVE = "active"
    PASSIVE = "passive"


class Task(str, Enum):
    CLASSIFICATION = "classification"
    REGRESSION = "regression"


@dataclass(frozen=True)
class PartyFrame:
    """df with declared roles of its columns. Features are addressed by name, never by position."""

    df: DataFrame
    id_col: str
    feature_cols: tuple[str, ...]
    label_col: str | None = None
    task: Task = Task.CLASSIFICATION

    @property
    def role(self) -> Role:
        return Role.PASSIVE if self.label_col is None else Role.ACTIVE

    @property
    def header(self) -> list[str]:
        return [self.id_col, *([self.label_col] if self.label_col else []), *self.feature_cols]

    @property
    def n_features(self) -> int:
        return len(self.feature_cols)

    @property
    def n_samples(self) -> int:
        return self.df.count()

    @property
    def ids(self) -> DataFrame:
        return self.df.select(self.id_col)

    @property
    def features(self) -> DataFrame:
        return self.df.select(*self.feature_cols)

    @property
    def labels(self) -> DataFrame:
        """Class labels as integers, regression labels as they are."""
        if self.label_col is None:
            raise ValueError("a passive party has no label")
        y = F.col(self.label_col)
        return self.df.select(y.cast("int").alias(self.label_col) if self.task is Task.CLASSIFICATION else y)

    def table(self) -> DataFrame:
        return self.df.select(*self.header)

    def with_df(self, df: DataFrame, feature_cols: tuple[str, ...] | None = None) -> PartyFrame:
        return replace(self, df=df, feature_cols=self.feature_cols if feature_cols is None else tuple(feature_cols))

    def rename(self, names: list[str]) -> PartyFrame:
        """New names for the whole header, in its order."""
        if len(names) != len(self.header):
            raise ValueError("as many names as columns are needed")
        df = self.table().toDF(*names)
        k = 2 if self.label_col else 1
        return PartyFrame(df, names[0], tuple(names[k:]), names[1] if self.label_col else None, self.task)

    def filter(self, ids: DataFrame) -> PartyFrame:
        """Rows whose id is in the first column of ids; repeats of an id in this table stay."""
        wanted = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct()
        return self.with_df(self.df.join(wanted, self.id_col, "left_semi"))

    def intersect(self, *others: PartyFrame) -> PartyFrame:
        out = self
        for o in others:
            out = out.filter(o.ids)
        return out

    def filter_fields(self, target: list[str | int] | None = None, excluding: list[str | int] | None = None) -> PartyFrame:
        """Keep or leave out features, by name or by place among the features."""
        name = lambda f: self.feature_cols[f] if isinstance(f, int) else f
        wanted = [name(f) for f in target] if target is not None else list(self.feature_cols)
        gone = {name(f) for f in excluding or ()}
        unknown = [f for f in [*wanted, *gone] if f not in self.feature_cols]
        if unknown:
            raise ValueError(f"no such features: {unknown}")
        return self.with_df(self.df, tuple(f for f in wanted if f not in gone))

    def vertical_split(self, passive_share: float) -> tuple[PartyFrame, PartyFrame]:
        """(active, passive): the passive party gets the first int(share * n) features."""
        k = int(passive_share * self.n_features)
        return self.with_df(self.df, self.feature_cols[k:]), PartyFrame(self.df, self.id_col, self.feature_cols[:k], None, self.task)

    def permuted(self, option: str = "sequence", seed: int = 0, importances: dict[str, float] | None = None) -> PartyFrame:
        """Features in another order: as they are (sequence), by a hash of seed and name (random), or by
        falling importance, the name deciding between equal ones."""
        order = {
            "sequence": lambda c: 0,
            "random": lambda c: hashlib.md5(f"{seed}-{c}".encode()).hexdigest(),
            "importance": lambda c: (-importances[c], c),
        }[option]
        return self.with_df(self.df, tuple(sorted(self.feature_cols, key=order)))

    def feature_split(self, n: int) -> list[PartyFrame]:
        """Groups of equally many features; the last takes the remainder. The label stays in each."""
        step = self.n_features // n
        cuts = [k * step for k in range(n)] + [self.n_features]
        return [self.with_df(self.df, self.feature_cols[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
