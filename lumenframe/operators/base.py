"""Operators as SQL over DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


class SqlOp:
    """A relation-valued SQL text over named inputs (``{px}``); call it with a DataFrame for each.

    Parameters are written as ``:name`` and have defaults; numbers only.
    """

    def __init__(self, text: str, **defaults: float) -> None:
        self.raw, self.defaults = text.strip(), defaults
        self.inputs = tuple(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))

    def text(self, **params: float) -> str:
        if extra := set(params) - set(self.defaults):
            raise TypeError(f"no such parameter: {extra}")
        out = self.raw
        for k, v in (self.defaults | params).items():
            out = re.sub(rf":{k}\b", repr(v), out)
        return out

    def __call__(self, *frames: DataFrame, **params: float) -> DataFrame:
        if len(frames) != len(self.inputs):
            raise TypeError(f"it takes {self.inputs}")
        return frames[0].sparkSession.sql(self.text(**params), **dict(zip(self.inputs, frames, strict=True)))

    def ansi(self, views: dict[str, str], **params: float) -> str:
        """The same statement for another SQL engine, with the inputs' definitions as common table expressions."""
        body = self.text(**params)
        for i in self.inputs:
            body = body.replace("{" + i + "}", i)
        body = re.sub(r"\bpercentile\(", "quantile_cont(", body)
        heads = ",\n".join(f"{i} as ({views[i]})" for i in self.inputs)
        recursive = "recursive " if re.match(r"with recursive\b", body) else ""
        body = re.sub(r"^with (recursive )?", "", body) if body.startswith("with ") else None or body
        joint = ",\n" if self.raw.startswith("with ") else "\n"
        return f"with {recursive}{heads}{joint}{body}"
