import importlib
import pkgutil


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{m.name}")
