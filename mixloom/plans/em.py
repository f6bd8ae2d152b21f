"""Expectation-Maximisation over packed points."""

from __future__ import annotations

import time
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from mixloom.model import DegenerateComponent, Mixture, as_mixture
from mixloom.plans.blocks import XY, Sums, for_one_pass, moments, packed, sum_blocks, sum_many
from mixloom.schemas import FIT_HISTORY


@dataclass(frozen=True)
class Epoch:
    epoch: int
    loglik: float  # of the parameters the epoch started from
    seconds: float


@dataclass(frozen=True)
class FitResult:
    mixture: Mixture
    history: list[Epoch]
    n_points: int | None
    converged: bool = False
    final_loglik: float | None = None
    trainer: str = "em"
    extra: dict = field(default_factory=dict)

    @property
    def epochs(self) -> int | None:
        """Epochs or steps that ran; None where the trainer does not tell."""
        return self.extra.get("epochs", len(self.history))

    def model_df(self, spark: SparkSession) -> DataFrame:
        return self.mixture.to_df(spark)

    def history_df(self, spark: SparkSession, run_id: str = "run") -> DataFrame:
        rows = [(run_id, e.epoch, e.loglik, e.seconds) for e in self.history]
        return spark.createDataFrame(rows, FIT_HISTORY)


def em_step(
    points: DataFrame, model: Mixture | DataFrame, cols=XY, reg_covar: float = 0.0
) -> tuple[Mixture, float]:
    """One EM step: the improved model and the log-likelihood of the given one."""
    model = as_mixture(model)
    sums = sum_blocks(for_one_pass(points, cols), model)
    return moments(sums, model, reg_covar), sums.total


def log_likelihood(points: DataFrame, model: Mixture | DataFrame, cols=XY) -> float:
    """Log-likelihood of all points under a model."""
    return sum_blocks(for_one_pass(points, cols), as_mixture(model)).total


#: A fit that asks for the sums of a model, hard or not, and goes on with them.
Rounds = Generator[tuple[Mixture, bool], Sums, FitResult]


def run_together(blocks: DataFrame, fits: list[Rounds]) -> list[FitResult | ValueError]:
    """Run fits over the same packed points, one pass for all that still go on.

    There are as many jobs as the longest fit asks for passes. A fit that fails
    leaves its error in its place; the others go on.
    """
    results: list = [None] * len(fits)
    asked: dict[int, tuple[Mixture, bool]] = {}

    def advance(number: int, sums: Sums | None) -> None:
        asked.pop(number, None)
        try:
            request = fits[number].send(sums)
            try:
                request[0].cholesky()
            except DegenerateComponent as error:
                request = fits[number].throw(error)
            asked[number] = request
        except StopIteration as end:
            results[number] = end.value
        except ValueError as error:
            results[number] = error

    for number in range(len(fits)):
        advance(number, None)
    while asked:
        numbers = list(asked)
        for number, sums in zip(numbers, sum_many(blocks, [asked[n] for n in numbers])):
            advance(number, sums)
    return results


def run_alone(blocks: DataFrame, rounds: Rounds) -> FitResult:
    (result,) = run_together(blocks, [rounds])
    if isinstance(result, ValueError):
        raise result
    return result


def em_rounds(
    start: Mixture | DataFrame,
    max_iter: int = 50,
    tol: float = 0.0,
    tol_kind: str = "total",
    reg_covar: float = 0.0,
    final_loglik: bool = False,
    on_epoch: Callable[[Epoch, Mixture], None] | None = None,
) -> Rounds:
    """The epochs of ``fit_em``."""
    if tol_kind not in ("total", "mean"):
        raise ValueError("tol_kind must be 'total' or 'mean'")
    model = as_mixture(start)
    history: list[Epoch] = []
    converged = False
    n_points = 0
    last = None
    for epoch in range(1, max_iter + 1):
        begun = time.perf_counter()
        try:
            sums = yield model, False
            improved = moments(sums, model, reg_covar)
        except DegenerateComponent as error:
            raise DegenerateComponent(f"epoch {epoch}: {error}", model, history) from None
        model = improved
        n_points = sums.count
        history.append(Epoch(epoch, sums.total, time.perf_counter() - begun))
        if on_epoch is not None:
            on_epoch(history[-1], model)
        level = sums.total / sums.count if tol_kind == "mean" else sums.total
        if tol > 0 and last is not None and abs(level - last) < tol:
            converged = True
            break
        last = level
    closing = (yield model, False).total if final_loglik else None
    return FitResult(model, history, n_points, converged, closing)


def fit_em(
    points: DataFrame,
    start: Mixture | DataFrame,
    max_iter: int = 50,
    tol: float = 0.0,
    tol_kind: str = "total",
    reg_covar: float = 0.0,
    cols=XY,
    storage: str = "memory",
    spread: int | None = None,
    final_loglik: bool = False,
    on_epoch: Callable[[Epoch, Mixture], None] | None = None,
) -> FitResult:
    """Fit from a given start.

    With ``tol = 0`` exactly ``max_iter`` epochs run. A positive ``tol`` stops
    the fit once the log-likelihood (``tol_kind='total'``) or its mean per point
    (``'mean'``) changes by less than that between two epochs. ``on_epoch`` sees
    each epoch and its model, e.g. to save the model so that a fit whose driver
    is lost can go on from there as its start.
    """
    with packed(points, cols, storage, spread) as blocks:
        return run_alone(
            blocks, em_rounds(start, max_iter, tol, tol_kind, reg_covar, final_loglik, on_epoch)
        )
