"""quarry: Spark-native knowledge-base retrieval, question bank and learning analytics.

Every job is a function ``DataFrame -> DataFrame`` built from the public
DataFrame / SQL API, with Arrow-batched Python only where numpy is the
natural tool (dense vector scoring).
"""

from quarry.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
