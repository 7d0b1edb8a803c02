"""Archive scan: ZIP files of delimited text whose header changes over the years.

Reading and meaning are apart. A first, small job lists the members of every archive; the members are dealt over tasks,
and each task streams one member at a time and hands over blocks: the header and the cells of some rows, all text. What
a header means is decided once per block by Spark expressions, which then open the rows and parse them.
"""

import csv
import io
import itertools
import unicodedata
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from navgrid.functions import normalise_id, positive, subclass_or_blank, to_day, to_double
from navgrid.schema import DATE_COLUMN, ID_COLUMNS, SUBCLASS_COLUMN, VALUE_COLUMN
from navgrid.session import materialise

BLOCK_ROWS = 20_000  # rows that a task hands over at once
FUNDS = 50_000  # wanted funds up to which they are sent to every task
MEMBERS = "ordem int, arquivo string, url string, membro_ix int, membro string, erro string"
BLOCKS = ("ordem int, arquivo string, membro_ix int, primeira long, cabecalho array<string>, linhas array<array<string>>, "
          "erro string")
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
           "None", "n/a", "nan", "null")  # fixed values: cells that count as absent

def arrow_uri(url: str) -> str:
    """A storage address of Hadoop as Arrow writes it."""
    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        url = url.replace(old, new, 1) if url.startswith(old) else url
    return "file://" + url[len("file:"):] if url.startswith("file:/") and not url.startswith("file://") else url


def open_shared(url: str):
    """Open a file of any storage that Arrow reaches (local, HDFS, S3, GCS)."""
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(arrow_uri(url))
    return system.open_input_file(path)


def _plain(character: str) -> str:
    """A character in capitals, taken apart (compatibility decomposition), without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", character.upper()) if not unicodedata.combining(c))


# How the 256 characters of Latin-1 are written, where that differs, from the rule above.
_PLAIN = {c: _plain(c) for c in map(chr, range(256)) if _plain(c) != c}
_ONE = {c: p for c, p in _PLAIN.items() if len(p) == 1}
_OTHER = {c: p for c, p in _PLAIN.items() if len(p) != 1}  # taken apart into several characters
_BLANKS = "".join(c for c in map(chr, range(256)) if c.isspace())


def column_name(cell: Column) -> Column:
    """A header cell as the accepted names are written: no outer blanks, capitals, compatibility decomposition, no accents.

    Covers every character of Latin-1, the encoding of the files, also those that become several (a half, a sharp s)."""
    out = F.btrim(cell, F.lit(_BLANKS))
    for character, parts in _OTHER.items():
        out = F.replace(out, F.lit(character), F.lit(parts))
    return F.translate(out, "".join(_ONE), "".join(_ONE.values()))


def place_of(header: Column, *accepted: str) -> Column:
    """Place from 1 of the first accepted name that the header has; null if it has none."""
    return F.coalesce(*[F.nullif(F.array_position(header, name), F.lit(0).cast("long")) for name in accepted])


def members_of(catalog: DataFrame, opener: Callable = open_shared) -> DataFrame:
    """One row per CSV member; an archive that cannot be read or has none gives a row with ``erro``."""
    def listed(arquivo: str, url: str) -> list[tuple]:
        try:
            with opener(url) as raw, zipfile.ZipFile(raw) as pack:
                found = [info.filename for info in pack.infolist() if info.filename[-4:].lower() == ".csv"]
        except Exception as problem:  # becomes the ledger entry of this file
            return [(-1, None, f"{arquivo}: {problem}")]
        return [(i, name, None) for i, name in enumerate(found)] or [(-1, None, f"{arquivo}: No CSV in the archive.")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*file, *member) for file in frame.itertuples(index=False, name=None) for member in listed(*file[1:])]
            yield pd.DataFrame(rows, columns=["ordem", "arquivo", "url", "membro_ix", "membro", "erro"])

    return catalog.select("ordem", "arquivo", "url").mapInPandas(work, MEMBERS)


def blocks_of(members: DataFrame, opener: Callable = open_shared, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Header and rows of every member, in blocks; a member that fails ends with a block that only has ``erro``."""
    def blocks(member) -> Iterator[tuple]:
        with opener(member.url) as raw, zipfile.ZipFile(raw) as pack, pack.open(member.membro) as data:
            lines = filter(None, csv.reader(io.TextIOWrapper(data, encoding="latin-1", newline=""), delimiter=";"))
            header, first = next(lines, []), 0
            while rows := list(itertools.islice(lines, block_rows)):
                if (longest := max(map(len, rows))) > len(header):
                    raise ValueError(f"a row of {longest} cells under a header of {len(header)}")
                yield first, header, rows, None
                first += len(rows)
            if not first:
                yield 0, header, [], None

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for member in (m for frame in frames for m in frame.itertuples(index=False)):
            start = (member.ordem, member.arquivo, member.membro_ix)
            try:
                for block in blocks(member) if member.erro is None else [(0, None, None, member.erro)]:
                    yield pd.DataFrame([(*start, *block)], columns=_BLOCK)
            except Exception as problem:  # becomes the ledger entry of this file
                yield pd.DataFrame([(*start, 0, None, None, f"{member.arquivo}: {problem}")], columns=_BLOCK)

    return members.mapInPandas(work, BLOCKS)


_BLOCK = ["ordem", "arquivo", "membro_ix", "primeira", "cabecalho", "linhas", "erro"]


def read_archives(catalog: DataFrame, opener: Callable = open_shared, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of all archives of a catalog with a load order column ``ordem``.

    As many tasks as there are archives list members, and as many as there are members read them: explicit numbers, so
    that the adaptive planner does not merge the tiny rows of either list into few tasks.
    """
    archives = max(1, catalog.count())
    members = materialise(members_of(catalog.repartition(archives, "url"), opener))
    return blocks_of(members.repartition(max(1, members.count()), "url", "membro_ix"), opener, block_rows)


def parse_daily(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Clean rows of the wanted funds and the error rows of the files, in one pass over the archives.

    The fund filter is an inner join before dates and numbers are parsed, on rows that have a valid identifier. Its way is
    named, by the number of funds: Spark takes the rows for as few as the list of members that they are read from, and would
    gather them all on the driver to broadcast them. A file without a value column fails only when it has a row of a wanted fund: that row carries the error, as a block without
    rows carries the error of its member.
    """
    names = F.transform("cabecalho", column_name)
    placed = (blocks.withColumn("_nomes", names)
              .withColumns({"_cnpj": place_of(F.col("_nomes"), *ID_COLUMNS), "_sub": place_of(F.col("_nomes"), SUBCLASS_COLUMN),
                            "_data": place_of(F.col("_nomes"), DATE_COLUMN), "_valor": place_of(F.col("_nomes"), VALUE_COLUMN)}))
    unknown = F.concat("arquivo", F.lit(": no identifier or no date among the columns "), F.array_join("_nomes", ", "))
    checked = placed.withColumn("erro", F.coalesce("erro", F.when(F.col("_cnpj").isNull() | F.col("_data").isNull(), unknown)))
    opened = checked.withColumn("_linhas", F.when(F.col("erro").isNull(), F.col("linhas"))).select(
        "ordem", "arquivo", "membro_ix", "primeira", "erro", "_cnpj", "_sub", "_data", "_valor",
        F.posexplode_outer("_linhas").alias("_i", "_celulas"))

    def cell(place: str) -> Column:
        text = F.get("_celulas", (F.col(place) - 1).cast("int"))
        return F.when(~text.isin(*MISSING), text)

    # Blocks with an error pass the join by a key of their own. Only the cells that are parsed go into it.
    key = F.when(F.col("erro").isNotNull(), F.lit("erro")).otherwise(normalise_id(cell("_cnpj")))
    lacking = F.when(F.col("_valor").isNull(), F.concat("arquivo", F.lit(f": no column {VALUE_COLUMN}")))
    cells = opened.select("ordem", "arquivo", "membro_ix", (F.col("primeira") + F.col("_i")).alias("linha"), key.alias("cnpj"),
                          cell("_sub").alias("_sub"), cell("_data").alias("_data"), cell("_valor").alias("_valor"),
                          F.coalesce("erro", lacking).alias("erro"))
    keys = wanted.select("cnpj").union(wanted.sparkSession.createDataFrame([("erro",)], "cnpj string"))
    way = "broadcast" if wanted.count() <= FUNDS else "merge"
    typed = cells.where("cnpj IS NOT NULL").join(keys.hint(way), "cnpj").select(
        "ordem", "arquivo", "membro_ix", "linha", "cnpj", subclass_or_blank("_sub").alias("id_subclasse"), to_day("_data").alias("data"),
        to_double("_valor").alias("valor_cota"), "erro")
    valid = F.col("data").isNotNull() & F.col("valor_cota").isNotNull() & positive("valor_cota")
    return typed.where(F.col("erro").isNotNull() | valid)
