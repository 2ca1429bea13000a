"""Where a model runs and in which number type, decided in the task that builds it.

On a cluster Spark's resource scheduling deals out devices (``spark.task.resource.gpu.amount``);
a task sees the addresses it was given. Factories that take ``device`` or ``dtype`` get them.
"""

from __future__ import annotations

import functools
import inspect

from pyspark import TaskContext

#: Number types by name (fixed values).
DTYPES = {"fp32": "float32", "float32": "float32", "fp16": "float16", "float16": "float16", "bf16": "bfloat16", "bfloat16": "bfloat16"}


def device_of(requested: str | None = None) -> str:
    """The device asked for, else the first one the task was given, else the processor."""
    if requested and requested != "auto":
        return requested
    context = TaskContext.get()
    given = context.resources().get("gpu") if context else None
    return f"cuda:{given.addresses[0]}" if given and given.addresses else "cpu"


def dtype_of(requested: str = "auto", device: str = "cpu") -> str:
    """The number type asked for; ``auto`` is half precision on a device and single on the processor."""
    if requested == "auto":
        return "bfloat16" if device.startswith("cuda") else "float32"
    if requested not in DTYPES:
        raise ValueError(f"no number type: {requested}")
    return DTYPES[requested]


def _build(factory, device: str | None, dtype: str | None, options: dict):
    takes = inspect.signature(factory).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in takes.values())
    given = dict(options)
    if every or "device" in takes:
        given["device"] = device_of(device)
    if every or "dtype" in takes:
        given["dtype"] = dtype_of(dtype or "auto", device_of(device))
    return factory(**{k: v for k, v in given.items() if every or k in takes})


def configured(factory, device: str | None = None, dtype: str | None = None, **options):
    """A factory that builds ``factory`` with those of the options that it takes."""
    return functools.partial(_build, factory, device, dtype, options)
