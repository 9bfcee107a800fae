"""Queries over the given tables, one or more per operator."""


def load():
    """Import all query modules and return the registry."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("use_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
