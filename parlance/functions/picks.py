"""Which models fit on a machine: a decision table over its memory, cores and kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of models.
SMALL, QUANTISED, FULL = "asr-base", "asr-large-v3-turbo-q5", "asr-large-v3-turbo"
LANGUAGE = ((15, "llm-qwen3-4b"), (23, "llm-qwen3-8b"), (None, "llm-qwen3-14b"))
MANY_CORES, LITTLE_FREE = 12, 3


def model_picks(ram_gb: Column, apple: Column, cores: Column, free_gb: Column) -> list[Column]:
    """asr, llm (null where memory is too small for one), confidence, and whether the user is warned.

    ``apple`` says that processors share one memory; elsewhere little free memory is a reason to warn.
    """
    middle = ram_gb.between(16, 23) & ~apple
    strong = middle & (cores >= MANY_CORES)
    asr = F.when(ram_gb <= 5, SMALL).when(ram_gb <= 9, QUANTISED).when(apple | strong | (ram_gb > 23), FULL).otherwise(QUANTISED)
    llm = F.when(ram_gb <= 5, F.lit(None).cast("string"))
    for upto, name in LANGUAGE:
        llm = llm.otherwise(name) if upto is None else llm.when(ram_gb <= upto, name)
    warned = (ram_gb <= 9) | ((ram_gb <= 23) & ~apple & (free_gb < LITTLE_FREE))
    return [asr.alias("asr"), llm.alias("llm"), F.when(strong, "medium").otherwise("high").alias("confidence"), warned.alias("warned")]
