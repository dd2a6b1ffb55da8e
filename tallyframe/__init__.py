"""tallyframe: retail-transaction analyses as Spark DataFrame operators.

Every operator takes the canonical ``sales`` DataFrame (see ``tallyframe.schema``)
and returns a DataFrame. Nothing is collected to the driver except where an ML
estimator has to be fitted.
"""

from tallyframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
