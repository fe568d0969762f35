"""tessera: versioned, verified data products built as Spark jobs.

A product declares named sources, an ordered list of SELECT transforms and a
typed, versioned interface. A run binds the sources as temp views, evaluates
each transform with ``spark.sql``, lands the result with ``append``/``upsert``/
``replace`` (key-bucketed Parquet, guards first), verifies the declared
contract and commits all tables plus watermarks as one immutable snapshot.
"""

from tessera.api import DataProduct
from tessera.model import ColumnSpec, Export, Incremental, Product, Rollup, Source, Transform, load_product, load_profile
from tessera.session import ensure_checkpoint_dir, scratch_path

__all__ = [
    "ColumnSpec",
    "DataProduct",
    "load_profile",
    "Export",
    "Incremental",
    "Product",
    "Rollup",
    "Source",
    "Transform",
    "load_product",
    "ensure_checkpoint_dir",
    "scratch_path",
]
