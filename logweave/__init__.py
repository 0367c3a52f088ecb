"""logweave: log template mining and template-quality scoring on Spark.

Every public operator is a ``DataFrame -> DataFrame`` function (or a Column
expression builder).  The heavy lifting is Spark SQL expressions; grouped
pandas functions are used only where a step is inherently sequential inside
a bounded group (prefix-tree clustering, diverse sampling).
"""

from logweave.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
