"""Labelled image collections: folders of label files and COCO documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probity.functions.scans import free
from probity.functions.text import contributor_from_path
from probity.sources.json_scan import ANY_JSON, scan_documents
from probity.sources.records import MAX_FILE, listing

JSON = r"(?i)\.json$"
IMAGE = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff|webp|gif|ppm)$"
#: Metadata keys that can name a contributor (fixed values).
CONTRIBUTOR_KEYS = ("contributor", "source", "batch", "vendor", "provider", "origin", "supplier", "unit", "agency")
STRUCTURAL = ("images", "train", "val", "test", "data")


def list_images(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """(path, length) of the images under root, sorted, then limited. Contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length").filter(F.col("path").rlike(IMAGE)).orderBy("path")
    return d if limit is None else d.limit(limit)


def decode_images(spark: SparkSession, root: str) -> DataFrame:
    """The image source; a file that can't be decoded has height -1."""
    return spark.read.format("image").option("recursiveFileLookup", True).load(root)


def parse_label_lines(lines: DataFrame, width: Column | int = 1, height: Column | int = 1) -> DataFrame:
    """lines(file, line, value) -> (file, line, label, box, error): `class cx cy w h`, normalised, to a pixel box x, y, w, h."""
    w = F.when(F.lit(width) == 0, 1).otherwise(F.lit(width)) if not isinstance(width, Column) else F.when(width == 0, 1).otherwise(width)
    h = F.when(F.lit(height) == 0, 1).otherwise(F.lit(height)) if not isinstance(height, Column) else F.when(height == 0, 1).otherwise(height)
    t = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.get(t, F.lit(i)).try_cast("double")
    few = F.size(t) < 5
    box = F.when(few, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array((num(1) - num(3) / 2) * w, (num(2) - num(4) / 2) * h, num(3) * w, num(4) * h))
    bad = num(0).isNull() | (~few & (num(1).isNull() | num(2).isNull() | num(3).isNull() | num(4).isNull()))
    d = lines.filter(F.trim("value") != "")
    return d.select("file", "line", F.when(~bad, num(0).cast("int")).alias("label"), F.when(~bad, box).alias("box"), F.when(bad, F.concat(F.lit("malformed label line: "), "value")).alias("error"))


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of a names file; blank lines keep their number."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("class_id", "name"))
    return d.select("class_id", F.trim("name").alias("name")).filter("name <> ''")


def class_names(spark: SparkSession, root: str) -> DataFrame:
    """(class_id, name) of a folder: of classes.txt, obj.names or names.txt, else of `names` in data.yaml, dataset.yaml or data.yml, a list or
    a mapping; no rows without any of them."""
    here = root.rstrip("/").rsplit("/", 1)[-1]
    rank = {n: i for i, n in enumerate(("classes.txt", "obj.names", "names.txt", "data.yaml", "dataset.yaml", "data.yml"))}
    name = F.element_at(F.split("file", "/"), -1)
    own = listing(spark, root, "/(" + "|".join(n.replace(".", r"\.") for n in rank) + ")$").filter(F.element_at(F.split("file", "/"), -2) == here)
    best = own.select("file", F.coalesce(*(F.when(name == n, i) for n, i in rank.items())).alias("r")).orderBy("r").first()
    if best is None:
        return spark.createDataFrame([], "class_id int, name string")
    if best["r"] < 3:
        return read_class_names(spark, best["file"])
    import yaml

    names = (yaml.safe_load(spark.read.text(best["file"], wholetext=True).first()[0]) or {}).get("names")  # one short file
    pairs = enumerate(names) if isinstance(names, list) else (names or {}).items()
    return spark.createDataFrame([(int(k), str(v)) for k, v in pairs], "class_id int, name string")


def _stem(c: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\.[^./]*$", ""), r"/images/([^/]*)$", "/labels/$1")


def _label_lines(spark: SparkSession, root: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), "value", (F.col("_metadata.file_block_start") + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("line"))
    return parse_label_lines(lines.filter(~F.col("file").rlike(r"(?i)/(classes|names)\.txt$")))


def yolo_errors(spark: SparkSession, root: str) -> DataFrame:
    """(file, error) of every label line that load_yolo can't read, and of label files that no image has."""
    img = listing(spark, root, IMAGE).select(_stem("file").alias("stem"))
    files = listing(spark, root, r"(?i)\.txt$").filter(~F.col("file").rlike(r"(?i)/(classes|names)\.txt$")).withColumn("stem", _stem("file"))
    alone = files.join(img, "stem", "left_anti").select("file", F.lit("a label file without an image").alias("error"))
    return _label_lines(spark, root).filter("error is not null").select("file", "error").unionByName(alone)


def folder_classes(images: DataFrame, names: DataFrame) -> DataFrame:
    """(folder, class_id) for images(path) without a label file, by the folder they are in: that of the name, or else a new one behind the
    known ones, in the order of the folders' first images. Structural folders (images, train, ...) are no classes."""
    parent = F.element_at(F.split("path", "/"), -2)
    folders = images.select("path", parent.alias("folder")).filter(~F.lower("folder").isin(*STRUCTURAL) & (F.col("folder") != "")).groupBy("folder").agg(F.min("path").alias("first"))
    known = names.groupBy("name").agg(F.min("class_id").alias("class_id"))
    most = names.agg(F.coalesce(F.max("class_id"), F.lit(-1)).alias("most"))  # one row
    d = folders.join(known, F.col("folder") == F.col("name"), "left").crossJoin(F.broadcast(most))
    new = F.col("class_id").isNull()
    rank = F.sum(new.cast("int")).over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, 0))  # a row a folder
    return d.select("folder", F.when(new, F.col("most") + rank).otherwise(F.col("class_id")).cast("int").alias("class_id"))


def load_yolo(spark: SparkSession, root: str, names: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row an image: sample_id, path, labels, boxes, contributor, folder, class_name, primary_label.

    The label file has the image's stem, images/ swapped for labels/. An image without one is labelled by its folder (folder_classes). names
    are those of the folder (class_names) unless given. Lines that can't be read are rows of yolo_errors. `limit` takes the first paths.
    """
    names = class_names(spark, root) if names is None else names
    img = listing(spark, root, IMAGE).select(F.col("file").alias("path"))
    img = (img if limit is None else img.orderBy("path").limit(limit)).withColumn("stem", _stem("path"))
    files = listing(spark, root, r"(?i)\.txt$").select(_stem("file").alias("stem"), F.lit(True).alias("has_file")).distinct()
    lab = _label_lines(spark, root).filter("error is null").withColumn("stem", _stem("file")).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line", "label", "box"))).alias("l"))
    d = img.join(files, "stem", "left").join(lab, "stem", "left")
    parts = F.split("path", "/")
    folder = F.get(F.filter(F.reverse(F.slice(parts, 1, F.size(parts) - 1)), lambda x: ~F.lower(x).isin(*STRUCTURAL)), F.lit(0))
    own = folder_classes(d.filter("has_file is null"), names)
    d = d.withColumn("parent", F.element_at(parts, -2)).join(own.withColumnRenamed("folder", "parent"), "parent", "left")
    bare = F.col("has_file").isNull() & F.col("class_id").isNotNull()
    labels = F.when(bare, F.array("class_id")).otherwise(F.coalesce(F.col("l.label"), F.array().cast("array<int>")))
    boxes = F.when(bare, F.array(F.array(*[F.lit(0.0)] * 4))).otherwise(F.coalesce(F.col("l.box"), F.array().cast("array<array<double>>")))
    d = with_primary_label(d.select(F.element_at(parts, -1).alias("sample_id"), "path", labels.alias("labels"), boxes.alias("boxes"), contributor_from_path(F.col("path")).alias("contributor"), folder.alias("folder"), "parent"))
    all_names = names.unionByName(own.select("class_id", F.col("folder").alias("name"))).groupBy("class_id").agg(F.min("name").alias("name"))
    return with_class_names(d.drop("parent"), all_names)


def with_primary_label(d: DataFrame) -> DataFrame:
    """Adds primary_label: the most frequent label, the smallest of ties, -1 without any."""
    distinct = F.array_sort(F.array_distinct("labels"))
    count = lambda x: F.size(F.filter("labels", lambda y: y == x))
    best = F.aggregate(distinct, F.struct(F.lit(-1).alias("v"), F.lit(0).alias("c")), lambda a, x: F.when(count(x) > a["c"], F.struct(x.alias("v"), count(x).alias("c"))).otherwise(a))
    return d.withColumn("primary_label", best["v"])


def with_class_names(samples: DataFrame, names: DataFrame, label: str = "primary_label") -> DataFrame:
    (key,) = free(samples, "class_of")
    n = names.select(F.col("class_id").alias(key), F.col("name").alias("class_name"))
    return samples.drop("class_name").join(n, F.col(label) == F.col(key), "left").drop(key).withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col(label).cast("string"))))


def contributor_from_metadata(v: Column) -> Column:
    """First non-blank contributor key of a JSON object, its metadata object included."""
    return F.coalesce(*(F.nullif(F.trim(F.try_variant_get(v, f"$.{head}{k}", "string")), F.lit("")) for head in ("", "metadata.") for k in CONTRIBUTOR_KEYS))


def _coco_parts(spark: SparkSession, path: str, whole: int) -> DataFrame:
    """(section, v) of a COCO document: its images, annotations and info. A document of over `whole` bytes is read by ranges."""
    size = listing(spark, path, ".*").agg(F.max("size")).first()[0] or 0
    if size > whole:
        objects, _ = scan_documents(spark, path)
        return objects.filter(F.col("section").isin("images", "annotations", "info")).select("section", F.try_parse_json("value").alias("v")).filter("v is not null")
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("j")).filter("j is not null")
    each = lambda c: doc.select(F.lit(c).alias("section"), F.explode(F.try_variant_get("j", f"$.{c}", "array<variant>")).alias("v"))
    return each("images").unionByName(each("annotations")).unionByName(doc.select(F.lit("info").alias("section"), F.try_variant_get("j", "$.info", "variant").alias("v")))


def coco_errors(spark: SparkSession, path: str, whole: int = MAX_FILE) -> DataFrame:
    """(section, value, error) of what load_coco can't place: images without an id, annotations without an image's id, or of an image that isn't there."""
    d = _coco_parts(spark, path, whole)
    num = lambda c: F.try_variant_get("v", f"$.{c}", "bigint")
    img = d.filter("section = 'images'").select(num("id").alias("id"), "v")
    ann = d.filter("section = 'annotations'").select(num("image_id").alias("id"), "v")
    say = lambda x, section, text: x.select(F.lit(section).alias("section"), F.to_json("v").alias("value"), F.lit(text).alias("error"))
    lost = ann.filter("id is not null").join(img.select("id").filter("id is not null").distinct(), "id", "left_anti")
    return say(img.filter("id is null"), "images", "an image without an id").unionByName(say(ann.filter("id is null"), "annotations", "an annotation without an image's id")).unionByName(say(lost, "annotations", "an annotation of no image"))


def coco_image_dir(spark: SparkSession, path: str, explicit: str | None = None) -> str:
    """The folder of a COCO document's images: the explicit one if it is there, else the first usual folder beside the document, or
    beside its folder if that is called annotations, else the folder itself."""
    up = lambda p: p.rstrip("/").rsplit("/", 1)[0]

    def there(p: str) -> bool:
        f = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = f.getFileSystem(spark._jsc.hadoopConfiguration())
        return fs.exists(f) and fs.getFileStatus(f).isDirectory()

    here = up(path)
    outer = up(here) if here.endswith("/annotations") else None
    tried = ([explicit] if explicit else []) + [f"{here}/{n}" for n in ("images", "train", "val", "data", "img")] + ([f"{outer}/{n}" for n in ("images", "train2017", "val2017")] if outer else [])
    return next((p for p in tried if there(p)), outer or here)


def with_existing(samples: DataFrame, root: str) -> DataFrame:
    """samples(path, ...) with `exists`: whether root has that file, by its path below root; a path of its own (with a scheme or /) is compared whole."""
    tail = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    full, key, have = free(samples, "full", "file", "have")
    own = F.when(F.col("path").rlike(r"^(/|[a-z0-9]+:/)"), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    files = listing(samples.sparkSession, root, ".*").select(tail("file").alias(key), F.lit(True).alias(have))
    d = samples.withColumn(full, tail(own)).join(files, F.col(full) == F.col(key), "left")
    return d.withColumn("exists", F.coalesce(have, F.lit(False))).drop(full, key, have)


def load_coco(spark: SparkSession, path: str, whole: int = MAX_FILE) -> DataFrame:
    """One row an image of a COCO document: image left join annotations on image_id; contributor of the image, the document, or the path.

    Documents of over `whole` bytes are read by ranges in many tasks, to the same rows; what can't be placed is in coco_errors."""
    parts = _coco_parts(spark, path, whole)
    info = parts.filter("section = 'info'").agg(F.max(contributor_from_metadata(F.col("v"))).alias("top"))  # one row
    img = parts.filter("section = 'images'").select("v").crossJoin(F.broadcast(info))
    ann = parts.filter("section = 'annotations'").select("v")
    img = img.select(F.try_variant_get("v", "$.id", "bigint").alias("image_id"), F.try_variant_get("v", "$.file_name", "string").alias("path"), F.try_variant_get("v", "$.width", "int").alias("width"), F.try_variant_get("v", "$.height", "int").alias("height"), F.coalesce(contributor_from_metadata(F.col("v")), "top", contributor_from_path(F.try_variant_get("v", "$.file_name", "string"))).alias("contributor"))
    ann = ann.select(F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.image_id", "bigint").alias("image_id"), F.try_variant_get("v", "$.category_id", "int").alias("label"), F.try_variant_get("v", "$.bbox", "array<double>").alias("box"))
    ann = ann.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "box"))).alias("a"))
    d = img.join(ann, "image_id", "left").select("image_id", "path", "width", "height", "contributor", F.coalesce(F.col("a.label"), F.array().cast("array<int>")).alias("labels"), F.coalesce(F.col("a.box"), F.array().cast("array<array<double>>")).alias("boxes"))
    return with_primary_label(d)


def yolo_lines(samples: DataFrame, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """The inverse of parse_label_lines: one row a box, six decimals."""
    d = samples.select("path", F.posexplode(F.arrays_zip("labels", "boxes")).alias("line", "x"))
    b = F.col("x.boxes")
    return d.select("path", "line", F.format_string("%d %.6f %.6f %.6f %.6f", F.col("x.labels"), (b[0] + b[2] / 2) / width, (b[1] + b[3] / 2) / height, b[2] / width, b[3] / height).alias("value"))


def summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("primary_label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("contributor")).alias("contributors"))


def detect_format(spark: SparkSession, root: str) -> str:
    """coco, yolo or unknown, by all names under root and the keys of its JSON files."""
    if find_coco(spark, root):
        return "coco"
    known = listing(spark, root, r"(?i)(/(classes|names)\.txt|/obj\.names|/labels/[^/]*\.txt|/(data|dataset)\.ya?ml)$")
    if not known.isEmpty():
        return "yolo"
    beside = listing(spark, root, r"(?i)\.txt$").select(_stem("file").alias("stem")).join(listing(spark, root, IMAGE).select(_stem("file").alias("stem")), "stem", "left_semi")
    return "unknown" if beside.isEmpty() else "yolo"


def find_coco(spark: SparkSession, root: str, whole: int = MAX_FILE) -> str | None:
    """The annotation document under root: by the usual names, then the first path with the key annotations or categories at the top.

    One job reads the keys of all JSON files; those of over `whole` bytes are read by ranges."""
    src = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", ANY_JSON).text(root, wholetext=True).filter(F.col("_metadata.file_path").rlike(JSON) & (F.col("_metadata.file_size") <= whole))
    keys = src.select(F.col("_metadata.file_path").alias("file"), F.explode(F.json_object_keys("value")).alias("key"))
    if not listing(spark, root, JSON).filter(F.col("size") > whole).isEmpty():
        objects, files = scan_documents(spark, root, JSON, whole)
        one = files.filter("lead = '{' and tops = 1 and error is null").select("file")
        keys = keys.unionByName(objects.filter("section is not null").join(one, "file", "left_semi").select("file", F.col("section").alias("key")))
    usual = F.lower(F.element_at(F.split("file", "/"), -1)).rlike(r"^(annotations|instances|_annotations)")
    best = keys.filter(F.col("key").isin("annotations", "categories")).select("file", usual.alias("usual")).orderBy(F.desc("usual"), "file").first()
    return best["file"] if best else None


def _told(errors: DataFrame, one: str, many: str) -> list[str]:
    n = errors.count()
    return [f"{n} {one if n == 1 else many} couldn't be read"] if n else []


def load_dataset(spark: SparkSession, root: str, fmt: str | None = None) -> tuple[DataFrame, str, list[str]]:
    """(samples, format, errors) of a folder; an unknown one is its images alone, with an error that says so. The
    rows behind an error are those of yolo_errors or coco_errors."""
    fmt = fmt or detect_format(spark, root)
    if fmt == "coco":
        found = find_coco(spark, root)
        if found is None:
            return with_primary_label(spark.createDataFrame([], "path string, contributor string, labels array<int>")), fmt, ["no COCO document was found"]
        return load_coco(spark, found), fmt, _told(coco_errors(spark, found), "part of the document", "parts of the document")
    if fmt == "yolo":
        return load_yolo(spark, root), fmt, _told(yolo_errors(spark, root), "label line or file", "label lines or files")
    d = list_images(spark, root).select("path", contributor_from_path(F.col("path")).alias("contributor"), F.array().cast("array<int>").alias("labels"))
    return with_primary_label(d), "images-only", ["no annotations were recognised"]


def coco_document(samples: DataFrame, names: DataFrame) -> DataFrame:
    """One row with a COCO document of samples(path, width, height, labels, boxes): ids from 1 in the order of paths, for annotations
    in that order too; area = w * h, iscrowd 0.

    The document is one value by its format, so this is for collections that fit one file.
    """
    from probity.sources.tables import Store

    img = samples.select("path", "width", "height", "labels", "boxes", F.coalesce(F.greatest(F.size("boxes"), F.lit(0)), F.lit(0)).cast("bigint").alias("boxes_n"))
    img = Store(samples.sparkSession, "coco").keep(img.repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    parts = img.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("boxes_n").alias("boxes_all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    base = parts.select("part", zero(F.sum("rows").over(before)).alias("row_base"), zero(F.sum("boxes_all").over(before)).alias("box_base"))  # one row a partition
    img = img.withColumns({"row_here": zero(F.count(F.lit(1)).over(here)), "box_here": zero(F.sum("boxes_n").over(here))}).join(F.broadcast(base), "part")
    img = img.withColumns({"id": F.col("row_base") + F.col("row_here") + 1, "first_box": F.col("box_base") + F.col("box_here") + 1})
    ann = img.select("id", "first_box", F.posexplode(F.arrays_zip("labels", "boxes")).alias("k", "x"))
    b = F.col("x.boxes")
    ann = ann.select((F.col("first_box") + F.col("k")).alias("id"), F.col("id").alias("image_id"), F.col("x.labels").alias("category_id"), b.alias("bbox"), (b[2] * b[3]).alias("area"), F.lit(0).alias("iscrowd"))
    one = lambda d, name: d.agg(F.array_sort(F.collect_list(F.struct(*d.columns))).alias(name))
    doc = one(img.select("id", F.col("path").alias("file_name"), "width", "height"), "images").crossJoin(one(ann, "annotations")).crossJoin(one(names.select(F.col("class_id").alias("id"), "name"), "categories"))  # one row each
    return doc.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def discover_contributors(samples: DataFrame, contributor: str = "contributor") -> DataFrame:
    """Distinct contributors; rows without one are together under the name of their folder, or 'root'."""
    other = F.col("folder") if "folder" in samples.columns else F.lit(None).cast("string")
    return samples.select(F.coalesce(F.col(contributor), other, F.lit("root")).alias("contributor")).distinct()
