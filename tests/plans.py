import contextlib
import io


def plan_of(df) -> str:
    """The physical plan as text, before the frame has run."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
