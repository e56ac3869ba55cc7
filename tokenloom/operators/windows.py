"""The windows that most operators share: a file's tokens in order. (A window needs a session, so these are functions.)"""

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def in_order() -> WindowSpec:
    return Window.partitionBy("fid").orderBy("seq")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def upto() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def reverse() -> WindowSpec:
    return Window.partitionBy("fid").orderBy(F.desc("seq"))


def onward() -> WindowSpec:
    """This token and all after it, in the reverse order: Spark would compute a frame that ends in
    UNBOUNDED FOLLOWING anew for each row. Take min, max or last (the nearest) over it."""
    return reverse().rowsBetween(Window.unboundedPreceding, 0)


def after() -> WindowSpec:
    return reverse().rowsBetween(Window.unboundedPreceding, -1)
