"""Slugs with a word list of one's own, and paths."""

import os.path

from pyspark.sql import functions as F

from parchmint.functions import ids


def test_slugs(spark, tmp_path):
    """Titles and slugs as a library with a long list of common words has them."""
    words = "a the of in on and for with new novel high up to create # not a word".replace(" # ", "\n# ").split(" ")
    (tmp_path / "words.txt").write_text("\n".join(words) + "\n\n")
    stop = ids.read_words(spark, str(tmp_path / "words.txt"))
    want = {
        "Conductivity in Metal-Organic Frameworks": "conductivity", "Folding DNA to Create Nanoscale Shapes": "foldingdna", "A Novel Approach for the Study of MOFs": "mofs",
        "Métallo-Organic Réseau Conducteurs": "metalloorganic", "": "", "A The Of In On And": "", "Rotaxanes": "rotaxanes", "DNA Logic Gates": "dnalogic", "Ni3(HITP)2: A New MOF": "hitpmof",
        "High Electrical Conductivity in Ni3(HITP)2, a Semiconducting MOF": "electrical", "Scaling Up Digital Circuit Computation with DNA Strand Displacement Cascades": "scalingdigital",
        "Electronically Configurable Molecular-Based Logic Gates": "electronically", "Metal-Organic Framework Conductors": "metalorganic",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.s for r in df.select("t", ids.slug(F.col("t"), stop).alias("s")).collect()} == want
    assert df.where("t = 'DNA Logic Gates'").select(ids.slug(F.col("t"), stop, 3)).first()[0] == "dnalogicgates"
    assert df.where("t = 'Rotaxanes'").select(ids.make_key(F.lit("de Silva"), F.lit(2007), F.lit("Molecular logic"), stop)).first()[0] == "desilva2007molecular"


def test_paths(spark):
    paths = ["a/b", "", None, "/a", "../a", "a/../../b", "a/..", "..a/b", "./a//b", "a\x00b", "vault2/x", "a/../../vault/b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    full = F.concat(F.lit("/root/vault/"), "p")
    got = {r.p: (r.why, r.into, r.ok) for r in df.select("p", ids.path_problem(F.col("p")).alias("why"), ids.resolved(full).alias("into"), ids.within(full, F.lit("/root/./vault/")).alias("ok")).collect()}
    assert [got[p][0] for p in paths] == [None, "empty", "empty", "absolute", "parent", "parent", "parent", None, None, "null byte", None, "parent"]
    for p in paths:
        if p is not None:
            into = os.path.normpath(f"/root/vault/{p}")
            assert got[p][1:] == (into, into == "/root/vault" or into.startswith("/root/vault/"))
