"""The folding environment: states, rewards and ends of episodes as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, lit

#: What each number of the state vector is divided by.
SCALES = (("width_mm", 300.0), ("height_mm", 300.0), ("v", 20.0), ("temperature", 300.0), ("target", 50.0), ("v", 20.0), ("aoa_deg", 20.0), ("rho", 1.5), ("mu", 2e-5))


def normalised(state: dict[str, Column]) -> Column:
    """The state vector of nine numbers."""
    return F.array(*[state[name] / scale for name, scale in SCALES])


def denormalised(vector: Column) -> dict[str, Column]:
    """The flow state from the vector's places 2, 6, 7 and 8."""
    return {"v": vector[2] * 20.0, "aoa_deg": vector[6] * 20.0, "rho": vector[7] * 1.5, "mu": vector[8] * 2e-5}


def stepped(df: DataFrame, max_steps: int = 200) -> DataFrame:
    """Adds reward, terminated, truncated, use_high_fidelity and next_step from range_est, target, step, prev_range.

    A step asks for the high-fidelity solver while the range before it is below a tenth of the target, so the first
    step always does.
    """
    return df.withColumns({
        "reward": clamp(F.col("range_est") / F.col("target") - 1.0, -1.0, 10.0),
        "terminated": F.col("range_est") > 1.1 * F.col("target"),
        "truncated": F.col("step") >= max_steps,
        "use_high_fidelity": F.coalesce("prev_range", lit(0.0)) < 0.1 * F.col("target"),
        "next_step": F.col("step") + 1,
    })


def drifted(vector: Column, noise: Column, scale: float = 0.05) -> Column:
    """The state vector after a random step."""
    return F.zip_with(vector, noise, lambda s, e: s + scale * e)


def worth_high_fidelity(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Designs whose estimate is over a share of the target."""
    return df.where(F.col("range_est") > share * F.col("target"))
