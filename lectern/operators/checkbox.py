"""Which option of a form's row is ticked, by ink and without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster
from ..functions import words as W

COMPONENTS = "array<struct<x:int,y:int,w:int,h:int,area:int,cx:double,cy:double>>"
# How much fuller, or larger in ink, the ticked box is than the next one.
FILL_MARGIN, AREA_RATIO = 0.06, 1.22
#: Bytes of pixels that a worker looks at together; a larger image is looked at alone.
BATCH_BYTES = 4 << 20


def ink_components(images: DataFrame, width: str = "width", height: str = "height", grey: str = "grey") -> DataFrame:
    """images with components, the boxes, ink and middles of their connected ink; a row's image is width * height grey bytes.

    No shuffle. Null images, and those with fewer bytes than their size asks for, have none.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    shape = StructType([*images.schema.fields, StructField("components", _parse_datatype_string(COMPONENTS))])

    def find(batches):
        import pyarrow as pa

        def read(batch: pa.RecordBatch):
            sizes = zip(*(batch.column(c).to_pylist() for c in (width, height, grey)))
            pictures = [(w, h, g) if g is not None and w and h and w > 0 and h > 0 and len(g) >= w * h else (0, 0, b"") for w, h, g in sizes]
            found = raster.components(pictures)
            return batch.append_column("components", found.cast(pa.list_(pa.struct([(f.name, f.type) for f in found.type.value_type]))))

        for batch in batches:
            begin = held = 0
            for i, n in enumerate(batch.column(grey).to_pylist()):
                n = len(n or b"")
                if held and held + n > BATCH_BYTES:
                    yield read(batch.slice(begin, i - begin))
                    begin, held = i, 0
                held += n
            if begin < batch.num_rows:
                yield read(batch.slice(begin))

    return images.mapInArrow(find, shape)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _options(boxes: Column, question: Column) -> Column:
    """The row's options (text, x0, y0, x1, y1): what stands after the box that the question names, up to the next label."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(question, F.lit(""))), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*W.ROW_GENERIC))
    named = F.transform(boxes, lambda b: F.exists(words, lambda w: F.contains(F.lower(b["text"]), w)))
    at = F.array_position(named, True).cast("int")  # 0: none, and the row's first box is its label
    label = F.get(boxes, at - 1)
    tail = _stripped(F.substr(label["text"], F.locate(":", label["text"]) + 1))
    option = lambda text, b: F.struct(F.regexp_replace(text, "^[^A-Za-z]+", "").alias("text"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
    none = F.filter(F.transform(boxes, lambda b: option(b["text"], b)), lambda b: F.lit(False))
    head = F.when((at > 0) & F.contains(label["text"], F.lit(":")) & (F.length(tail) >= 2), F.array(option(tail, label))).otherwise(none)
    rest = F.slice(boxes, F.greatest(at, F.lit(1)) + 1, F.size(boxes))
    # the next field's label ends the options, unless none has come yet
    ends = F.transform(rest, lambda b, i: F.endswith(b["text"], F.lit(":")) & ((i > 0) | (F.size(head) > 0)))
    cut = F.array_position(ends, True).cast("int")
    own = F.slice(rest, 1, F.when(cut > 0, cut - 1).otherwise(F.size(rest)))
    return F.concat(head, F.transform(own, lambda b: option(b["text"], b)))


def _square(option: Column, components: Column) -> Column:
    """(size, fill, area) of the largest component that may be the option's box: beside its text, of its height, about square."""
    h = F.greatest(option["y1"] - option["y0"], F.lit(12.0))
    fits = F.filter(
        components,
        lambda c: c["cx"].between(option["x0"] - 0.7 * h, option["x0"] + 1.7 * h) & c["cy"].between(option["y0"] - 0.35 * h, option["y1"] + 0.35 * h)
        & c["h"].between(0.45 * h, 1.9 * h) & c["w"].between(0.45 * h, 2.0 * h) & (c["w"] / c["h"]).between(0.55, 1.8),
    )
    ranked = F.transform(fits, lambda c, i: F.struct((c["w"] * c["h"]).alias("size"), (-i).alias("first"), (c["area"] / (c["w"] * c["h"])).alias("fill"), c["area"].cast("double").alias("area")))
    return F.array_max(ranked)


def ticked(rows: DataFrame, boxes: str = "boxes", question: str = "question", components: str = "components", fill_margin: float = FILL_MARGIN, area_ratio: float = AREA_RATIO) -> DataFrame:
    """rows with option, confident, options and detail: the option whose box has clearly more ink than its siblings.

    boxes: array of (text, x0, y0, x1, y1) in pixels, in any order; components: those of ink_components(). The fullest box
    counts if it is fuller by fill_margin, the one with most ink if it has area_ratio times the next one's; if both count
    and disagree, or neither does, no option is given, nor where boxes or options are missing. Column expressions only.
    Null boxes, question or components: as empty.
    """
    held = F.filter(F.coalesce(F.col(boxes), F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")), lambda b: b["text"].isNotNull())
    ordered = F.transform(F.array_sort(F.transform(held, lambda b, i: F.struct(b["x0"].alias("x"), i.alias("i"), b.alias("b")))), lambda s: s["b"])
    trimmed = F.transform(ordered, lambda b: F.struct(_stripped(b["text"]).alias("text"), *(b[c].cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))))
    known = set(rows.columns)
    name = lambda n: next(x for x in (f"_{n}" + "_" * k for k in range(99)) if x not in known)
    b, o, f = name("boxes"), name("options"), name("found")
    out = rows.withColumn(b, trimmed).withColumn(o, F.when(F.size(b) >= 2, _options(F.col(b), F.col(question))))
    ink = F.coalesce(F.col(components), F.array().cast(COMPONENTS))
    squares = F.transform(o, lambda x: F.struct(x["text"].alias("text"), _square(x, ink).alias("s")))
    out = out.withColumn(f, F.filter(squares, lambda x: x["s"].isNotNull()))
    by = lambda value: F.sort_array(F.transform(f, lambda x: F.struct(x["s"][value].alias("v"), x["text"].alias("text"))), asc=False)
    fills, areas = by("fill"), by("area")
    fuller = F.get(fills, F.lit(0))["v"] - F.get(fills, F.lit(1))["v"] >= fill_margin
    larger = F.get(areas, F.lit(0))["v"] >= area_ratio * F.get(areas, F.lit(1))["v"]
    fullest, largest = F.get(fills, F.lit(0))["text"], F.get(areas, F.lit(0))["text"]
    same = F.array_position(F.transform(f, lambda x: x["s"]["fill"]), F.get(fills, F.lit(0))["v"]) == F.array_position(F.transform(f, lambda x: x["s"]["area"]), F.get(areas, F.lit(0))["v"])
    enough = (F.size(f) >= 2) & (F.size(f) >= F.size(o) - 1)
    option = F.when(enough & larger & (~fuller | same), largest).when(enough & fuller & ~larger, fullest)
    detail = (
        F.when(F.size(b) < 2, "no option labels found in this row").when(F.size(o) < 2, "fewer than two options")
        .when(~enough, "could not find the boxes next to the options").when(option.isNull(), "no box has clearly more ink than the others")
        .otherwise("the box with clearly the most ink")
    )
    options = F.coalesce(F.transform(o, lambda x: x["text"]), F.array().cast("array<string>"))
    out = out.withColumn("option", F.when(F.size(o) >= 2, option)).withColumn("confident", F.col("option").isNotNull()).withColumn("options", options).withColumn("detail", detail)
    return out.drop(b, o, f)
