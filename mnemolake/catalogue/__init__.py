"""Every registered query with the SQL it is held against."""

from mnemolake.catalogue.registry import ORACLE_SQL, QUERIES  # noqa: F401
from mnemolake.catalogue import graphs, lifecycle, reads, search, texts, vectors  # noqa: F401, E402
