"""A knowledge-retrieval engine expressed as PySpark DataFrame plans."""

__all__ = ["KnowledgeBase"]


def __getattr__(name: str):
    if name == "KnowledgeBase":  # Python workers import this package for single functions; they need no engine
        from mnemolake.engine import KnowledgeBase

        return KnowledgeBase
    raise AttributeError(name)
