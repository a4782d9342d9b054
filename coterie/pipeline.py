"""Stages in a row, fitted on a training table and applied to others."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from .party import PartyFrame


class Stage(ABC):
    def fit(self, frame: PartyFrame) -> Stage:
        return self

    @abstractmethod
    def transform(self, frame: PartyFrame) -> PartyFrame: ...


@dataclass
class Intersect(Stage):
    others: Sequence[PartyFrame]

    def transform(self, frame: PartyFrame) -> PartyFrame:
        return frame.intersect(*self.others)


@dataclass
class Transform(Stage):
    """A function of a frame; whatever it computes, it computes from the frame it is given."""

    function: Callable[[PartyFrame], PartyFrame]

    def transform(self, frame: PartyFrame) -> PartyFrame:
        return self.function(frame)


@dataclass
class FittedScale(Stage):
    """z-scores by the training table's means and deviations."""

    trained: PartyFrame | None = None

    def fit(self, frame: PartyFrame) -> FittedScale:
        self.trained = frame
        return self

    def transform(self, frame: PartyFrame) -> PartyFrame:
        from .operators.transform import scale

        return frame.with_df(scale(frame.df, frame.feature_cols, (self.trained or frame).df))


@dataclass
class Model(Stage):
    """Anything with fit(df) and predict(df)."""

    model: object

    def fit(self, frame: PartyFrame) -> Model:
        self.model.fit(frame.df)
        return self

    def transform(self, frame: PartyFrame) -> PartyFrame:
        return frame.with_df(self.model.predict(frame.df))


@dataclass
class Pipeline:
    stages: Sequence[Stage]

    def fit(self, frame: PartyFrame) -> Pipeline:
        for s in self.stages:
            frame = s.fit(frame).transform(frame)
        return self

    def transform(self, frame: PartyFrame) -> PartyFrame:
        for s in self.stages:
            frame = s.transform(frame)
        return frame
