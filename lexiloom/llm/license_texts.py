"""Texts of licence families, and paragraphs that only look like licences."""

from __future__ import annotations

# By family, the names that licences go by, their short identifiers, and paragraphs of notices and full texts.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "apache-2.0": (
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"),
        ("Apache-2.0",),
        (
            'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
            'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
            "Licensed to the Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The Foundation licenses this file to you under the Apache License, Version 2.0",
        ),
    ),
    "mit": (
        ("MIT License", "MIT licence"),
        ("MIT",),
        (
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        ),
    ),
    "isc": (
        ("ISC License", "Internet Systems Consortium license"),
        ("ISC",),
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        ),
    ),
    "bsd": (
        ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License"),
        ("BSD-2-Clause", "BSD-3-Clause"),
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        ),
    ),
    "gpl": (
        ("GNU General Public License, version 2", "GNU General Public License, version 3", "GNU General Public License", "GNU GPL v2 license", "GNU GPL v3 license", "GPLv2", "GPLv3"),
        ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        ),
    ),
    "lgpl": (
        ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU LGPL license", "LGPLv2.1", "LGPLv3"),
        ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"),
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
            "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        ),
    ),
    "agpl": (
        ("GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL license", "AGPLv3"),
        ("AGPL-3.0-only", "AGPL-3.0-or-later"),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        ),
    ),
    "mpl-2.0": (
        ("Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0 license"),
        ("MPL-2.0",),
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
            "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        ),
    ),
    "epl": (
        ("Eclipse Public License, version 2.0", "Eclipse Public License"),
        ("EPL-2.0",),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    ),
    "zlib": (
        ("zlib License", "zlib/libpng License"),
        ("Zlib",),
        (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        ),
    ),
    "bsl-1.0": (
        ("Boost Software License, version 1.0", "Boost Software License"),
        ("BSL-1.0",),
        (
            'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        ),
    ),
    "cc-by": (
        ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
        ("CC-BY-4.0", "CC-BY-3.0"),
        ("You are free to share and adapt the material for any purpose, even commercially, under the terms of the Creative Commons Attribution 4.0 International license: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",),
    ),
    "cc-by-sa": (
        ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"),
        ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
        ("Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",),
    ),
    "cc-by-nc": (
        ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"),
        ("CC-BY-NC-4.0", "CC-BY-NC-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License: you may not use the material for commercial purposes.",),
    ),
    "cc-by-nd": (
        ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
        ("CC-BY-ND-4.0",),
        ("Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License: if you remix, transform, or build upon the material, you may not distribute the modified material.",),
    ),
    "public-domain": (
        ("Unlicense", "CC0 1.0 Universal license", "CC0 1.0 Public Domain Dedication"),
        ("CC0-1.0", "Unlicense"),
        (
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means, as public domain software.",
            "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under CC0 1.0 Universal. This software is distributed without any warranty.",
        ),
    ),
}

# How notices name a licence; {} is the name or identifier.
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.")
# How short identifiers are given.
CLAIMS = ("SPDX-License-Identifier: {}", "{} licensed", "{} license", "licence {}")

# Sentences that share words with licences and are none.
ORDINARY = (
    "You need a driving license to rent a car here.", "The license plate was missing.", "He lost his fishing licence in the river.", "She holds a license to practise medicine.",
    "The pub was granted a licence to serve drink until midnight.", "License fees rose by ten percent last year.", "Poetic license allows such changes.", "The ministry revoked the operating licence of the mine.",
    "A marriage license is issued by the county.", "The software license server is down again.", "Please renew your licence before May.", "The broadcaster's licence fee is frozen.",
    "Permission to land was granted by the tower.", "He asked for permission to leave the table.", "Without permission nobody may enter the building.", "The file has the wrong permissions.", "Ask your parents for permission first.",
    "The warranty covers parts and labour for two years.", "The police searched the house without a warrant.", "A warrant was issued for his arrest.", "The claim seems warranted by the data.", "This warrants further study.",
    "Copyright law was reformed in the last century.", "The copyright lawyer spoke for an hour.", "They sued over copyright infringement of the song.", "The copyright term is seventy years.",
    "The redistribution of income was debated in parliament.", "Wealth was redistributed among the heirs.", "Heat is redistributed by the ocean currents.",
    "The beach is in the public domain, the court found.", "Public domain records were searched for the deed.", "Creative commons rooms are open to all students.", "He studied at MIT for two years.", "The Apache people live in the Southwest.",
    "Gnu herds moved across the plain.", "Mozilla made a browser.", "An eclipse of the public imagination needs no license.", "The general public has no license to enter.", "Version 3 of the plan was licensed to others.",
    "Die Lizenz zum Fahren wurde mit dem Brief entzogen.", "Sie brauchen die Permission mit Stempel.", "Le permis et la licence de pêche sont valables un an.", "La licencia de conducir caduca en mayo.", "Licenciado en letras, trabaja en la biblioteca.",
)
