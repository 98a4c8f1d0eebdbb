"""Separability of labelled and continuous targets in feature space, on Spark."""

__all__ = ["ContinuousSeparability", "DiscreteSeparability"]


def __getattr__(name: str):
    # On demand, so that Python workers load only the modules they use.
    if name in __all__:
        from isthmus import estimators

        return getattr(estimators, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
