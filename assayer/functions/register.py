"""The text functions under SQL names."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import fixed


def register(spark: SparkSession) -> None:
    """Registers norm_text, nfkc_fold, seq_ratio and case_id."""

    signs = "".join(fixed.FRACTIONS)
    vulgar, apart = re.compile(f"[{signs}]"), re.compile(rf"(?<=[\d{signs}])(?=[{signs}])")

    @F.pandas_udf(T.StringType())
    def norm_text(s: pd.Series) -> pd.Series:
        def tidy(text: str) -> str:
            plain = vulgar.sub(lambda m: fixed.FRACTIONS[m[0]], apart.sub(" ", text)).replace("\u2044", "/")
            return "\n".join(" ".join(x.split()) for x in unicodedata.normalize("NFKC", plain).splitlines()).strip()

        return s.map(tidy, na_action="ignore")

    @F.pandas_udf(T.StringType())
    def nfkc_fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")

    @F.pandas_udf(T.DoubleType())
    def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs], dtype="float64")

    spark.udf.register("norm_text", norm_text)
    spark.udf.register("nfkc_fold", nfkc_fold)
    spark.udf.register("seq_ratio", seq_ratio)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION case_id(canonical STRING) RETURNS STRING RETURN concat('case_', sha2(canonical, 256))")
