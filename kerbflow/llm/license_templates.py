"""Licence statements to compare with: names in usual wordings, and sentences of short licence texts."""

# SPDX identifier and the names under which the licence is cited.
NAMES = {
    "AGPL-3.0": ["the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["the Apache License, Version 2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License"],
    "BSD-3-Clause": ["the BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    "GPL-2.0": ["the GNU General Public License, version 2"],
    "GPL-3.0": ["the GNU General Public License, version 3"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0"],
}
WORDINGS = ["Licensed under {}", "Released under {}", "This work is licensed under {}", "Distributed under the terms of {}"]

# Sentences of licence files.
SENTENCES = {
    "Apache-2.0": ["you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}


def templates() -> list[tuple[str, str]]:
    """(licence, statement) rows."""
    rows = [(spdx, wording.format(name)) for spdx, names in NAMES.items() for name in names for wording in WORDINGS]
    rows += [(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in NAMES]
    return rows + [(spdx, s) for spdx, sentences in SENTENCES.items() for s in sentences]
