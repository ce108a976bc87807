"""opsledger: warehouse-operations analytics as Spark DataFrame operators.

Every public operator takes DataFrames plus plain parameters and returns a
DataFrame. "Now" is always an explicit ``as_of`` argument so results are
reproducible. Most operators are one lazy plan; those that number rows or
share an intermediate write it to the session's shared folder while they are
built (README).
"""

from opsledger.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
