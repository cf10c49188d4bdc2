import numpy as np
import pytest

from taskloom.llm import licences
from tests.llm import corpus


@pytest.fixture(scope="module")
def model():
    return licences.trained(licences.Settings())


def found(model, text):
    import pyarrow as pa

    from taskloom.llm import _words

    out = set()
    plain = licences._plain(pa.array([text]))
    for g, cased in zip(_words.words_of(plain), _words.words_of(plain, False), strict=True):
        for i, j, k in model.notices(g.hashes, _words.windows(g.hashes, 2), cased.hashes):
            if hit := model.judge(g.hashes[i:j], k):
                out.add(hit[0])
    return out


@pytest.mark.parametrize("family", licences.FAMILIES)
def test_templates_are_found_in_prose(model, family):
    prose = " ".join(f"word{i}" for i in range(200))
    for t in licences.TEMPLATES[family]:
        for text in (t, t.upper(), f"{prose} {t} {prose}", f"{prose}\n{t}\n{prose}"):
            assert family in found(model, text), text


def test_others_are_unknown(model):
    for text in ("the license of the driver was lost", "this work is on the table and all rights of way", "Permission was granted by the school", "version 3 of the song", ""):
        assert not found(model, text), text


def test_odd_rows(spark):
    data = [*corpus.rows(), (900, "Released under the MIT License.", None, None, 1), (900, "Released under the MIT License.", None, None, 1), (None, None, None, None, None)]
    df = corpus.frame(spark, data).withColumnRenamed("lang", "licences")
    got = licences.scan(df).collect()
    assert len(got) == len(data)
    assert {r.doc_id: r.licences for r in got if r.licences} == {900: "MIT"}
    assert all((r.probability is None) == (r.n_found == 0) for r in got)
    assert licences.scan(df.limit(0)).count() == 0


def test_each_notice_of_several_is_found(spark):
    """Notices in a row, on one line and far longer lists of them, and one after a stretch of any length."""
    nc, mit, apache = "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", licences.TEMPLATES["Apache-2.0"][1]
    one_of_each = [licences.TEMPLATES[f][0] for f in licences.FAMILIES]
    texts = [(f"{nc}\n{mit}", "CC-BY-NC,MIT", 2), (f"{mit} {nc} {mit}", "CC-BY-NC,MIT", 3), ("\n".join(one_of_each), ",".join(licences.FAMILIES), len(one_of_each))]
    for shift in range(60, 100, 7):
        texts.append(("of the License " * (shift // 3) + apache, "Apache-2.0", 1))
    got = licences.scan(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_found) for r in got} == {i: (f, n) for i, (_, f, n) in enumerate(texts)}


def test_versions_headers_and_unknown_licences(spark):
    def header(name, version):
        return (
            "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU "
            f"{name} as published by\n * the Free Software Foundation; either version {version} of the License, or\n * (at your option) any later version."
        )

    general = "General Public License"
    texts = {
        header(general, 2): "GPL-2.0",
        header(general, 3): "GPL-3.0",
        header(general, 4): "unknown",
        header(f"Affero {general}", 3): "AGPL-3.0",
        header(f"Lesser {general}", 2.1): "LGPL-2.1",
        header(f"Lesser {general}", 3): "LGPL-3.0",
        "Licensed under the Apache License, Version 1.1.": "unknown",
        "Licensed under the Tapir Sharing License.": "unknown",
        "SPDX-License-Identifier: Tapir-1.0": "unknown",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "Apache-2.0,MIT",
        "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
        licences._ISC: "ISC",
        licences._MIT: "MIT",
        "A driver is licensed under the law and may park": "",
    }
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: r.licences for r in got} == texts


# Held out: none of these is made by the grammar that the model is trained on.
HELD_OUT = {
    "Source files here carry an MIT license, have fun with them": "MIT",
    "Everything in this folder is MIT unless a file says otherwise, see license": "MIT",
    "License of this module: Apache 2.0 (see the text in the root folder)": "Apache-2.0",
    "Copyright 2019 by the authors. Apache License 2.0": "Apache-2.0",
    "Our code is free software under Apache-2.0, patches welcome": "Apache-2.0",
    "This library may be redistributed under the GNU LGPL version 2.1": "LGPL-2.1",
    "Free software, licensed under LGPLv3": "LGPL-3.0",
    "GPLv2 licensed kernel module": "GPL-2.0",
    "You can use it under the terms of the GNU GPL version 3": "GPL-3.0",
    "This tool is GPL v3 licensed free software": "GPL-3.0",
    "It is released to everybody under the AGPLv3": "AGPL-3.0",
    "Made available under the Mozilla Public License 2.0 by its authors": "MPL-2.0",
    "All of it is licensed MPL 2.0": "MPL-2.0",
    "Released by the lab under a BSD license": "BSD",
    "Distributed under the 3-clause BSD license by its maintainers": "BSD",
    "Photos are licensed under CC BY-SA 4.0 by their owners": "CC-BY-SA",
    "Text available under the Creative Commons Attribution-ShareAlike license": "CC-BY-SA",
    "Pictures shared under CC BY-NC 4.0 for teaching": "CC-BY-NC",
    "The data set is published under CC0": "CC0-1.0",
    "Plugin code under the Eclipse Public License 2.0": "EPL-2.0",
    "Use, modification and distribution are subject to the Boost Software License, Version 1.0": "BSL-1.0",
    "Small utilities, released under the ISC license": "ISC",
    "Put it to any use, it is under the Unlicense": "Unlicense",
    "The package is open source under the GPL": "unknown",
}
NO_NOTICE = (
    "Researchers at MIT published a new paper on lasers",
    "He was a student at MIT for four years and liked it",
    "MIT is in Cambridge and has a large campus by the river",
    "Apache warriors rode through the canyon at dawn",
    "The Apache 2 roller coaster closed in spring",
    "the apache helicopter flew over the valley",
    "They bought BSD shirts in Berlin last summer",
    "The ISC met on Tuesday to elect its chairman",
    "The doctor is licensed to practise in two states",
    "Her driving license expired in May and she walked",
    "You need a fishing license to go to the lake",
    "A copyright lawyer came to the meeting with a folder",
    "Permission to land was granted by the tower",
    "The wine was distributed under the tables of the hall",
    "His rights were read to him and he was released",
    "The software crashed and the file was lost without a copy",
    "Free of charge, the museum opens its doors on Sunday",
    "The public domain of the king was small",
    "The terms of the treaty were signed by both kings",
    "Version 2.0 of the plan is due on Monday",
    "The boost came from the new engine of the car",
    "An eclipse will be seen in the public park at noon",
    "The Mozilla foundation held a meeting about the web",
    "Er kam mit dem Zug und ging mit der Licht aus mit Lizenz",
    "Creative people in the commons gave attribution to the poet",
)


def test_held_out_notices_and_sentences(model):
    """Precision, recall and family of notices in other words than the training's; the figures are in the README."""
    right = sum(found(model, t) == {f} for t, f in HELD_OUT.items())
    some = sum(bool(found(model, t)) for t in HELD_OUT)
    wrong = [t for t in NO_NOTICE if found(model, t)]
    assert right >= 0.9 * len(HELD_OUT), [(t, found(model, t)) for t, f in HELD_OUT.items() if found(model, t) != {f}]
    assert some >= 0.9 * len(HELD_OUT) and len(wrong) <= 0.1 * len(NO_NOTICE), wrong


def test_the_classifier_decides(spark):
    """Names alone don't make a notice: without the classifier's word all of them would."""
    rows = spark.createDataFrame(list(enumerate((*HELD_OUT, *NO_NOTICE))), "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(rows).collect()}
    every = {r.doc_id: r.licences for r in licences.scan(rows, settings=licences.Settings(least=0.0)).collect()}
    changed = [i for i in got if got[i] != every[i]]
    # What it holds back is mostly none, though a family was named there.
    assert len(changed) >= 5 and all(every[i] for i in changed) and sum(i >= len(HELD_OUT) for i in changed) >= 0.7 * len(changed)


def test_unknown_class_is_calibrated(model):
    """On held-out candidates, chances near 1 are notices and chances near 0 aren't."""
    import pyarrow as pa

    from taskloom.llm import _words

    chances, truth = [], []
    for texts, y in ((HELD_OUT, 1), (NO_NOTICE, 0)):
        for t in texts:
            plain = licences._plain(pa.array([t]))
            g, cased = next(_words.words_of(plain)), next(_words.words_of(plain, False))
            for i, j, _ in model.notices(g.hashes, _words.windows(g.hashes, 2), cased.hashes):
                margin = model._row(g.hashes[i:j]) @ model.weight
                margin = margin[:-1].max() - margin[-1]
                chances.append(1 / (1 + np.exp(-(model.slope * margin + model.offset))))
                truth.append(y)
    chances, truth = np.array(chances), np.array(truth)
    assert ((chances - truth) ** 2).mean() < 0.12 and truth[chances > 0.9].mean() > 0.9 and truth[chances < 0.1].mean() < 0.1
