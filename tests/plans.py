"""Reading facts off executed plans."""

import contextlib
import io
import re


def executed(df) -> str:
    """Final plan of a DataFrame that has been collected."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_part(df) -> str:
    return re.split(r"\n[ :+|-]*== Initial Plan ==", executed(df))[0]


def largest_method(df) -> int:
    """Bytes of the largest generated method of a collected DataFrame."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())), default=0)
