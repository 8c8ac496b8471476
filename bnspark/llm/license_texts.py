"""What the licence classifier learns from: public licence texts by paragraphs, and names of licences.

Fixed values: TEXTS and NAMES are public licence wording and SPDX identifiers.  Long licences stand here with
their notices and the paragraphs that are quoted most; the phrases that name a licence follow from FORMS."""

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
)
_GNU_WARRANTY = (
    " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
_GNU_NOTICE = (
    "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free"
    " Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GNU_COPY = "You should have received a copy of the GNU {} along with this program. If not, see https://www.gnu.org/licenses/."


def _gnu(subject: str, name: str, version: str) -> list[str]:
    return [
        _GNU_NOTICE.format(subject, name, version),
        subject + _GNU_WARRANTY.format(name),
        _GNU_COPY.format(name),
        f"GNU {name.upper()} Version {version}",
        f"This work is licensed under the GNU {name}, version {version}.",
        f"under the terms of version {version} of the GNU {name} as published by the Free Software Foundation.",
    ]


TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
        " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
        " persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
        " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
        " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
        " derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
        " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
        " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
        " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
        " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
        " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
        " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
        " for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it"
        " and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you"
        " use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
        ' accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute,'
        " and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the"
        " Software is furnished to do so, all subject to the following:",
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and"
        " the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works"
        " of the Software, unless such copies or derivative works are solely in the form of machine-executable object code"
        " generated by a source language processor.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"
        " http://www.boost.org/LICENSE_1_0.txt)",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific'
        " language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide,"
        " non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of,"
        " publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL-2.0": _gnu("This program", "General Public License", "2"),
    "GPL-3.0": _gnu("This program", "General Public License", "3"),
    "LGPL": _gnu("This library", "Lesser General Public License", "2.1") + _gnu("This library", "Lesser General Public License", "3"),
    "AGPL-3.0": _gnu("This program", "Affero General Public License", "3"),
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which"
        " is available at https://www.eclipse.org/legal/epl-2.0/",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION'
        " OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    ],
    "EUPL-1.2": [
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions"
        ' of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
    ],
    "CC-BY-NC": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or"
        " as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright"
        " interest in the software to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "All rights reserved.",
        "This software is proprietary and confidential. No part of it may be reproduced or transmitted without the prior written"
        " permission of the owner.",
    ],
}

# Names by family, as they stand in sentences; the first ones with a hyphen are SPDX identifiers, too.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "3-clause BSD license"],
    "Zlib": ["zlib License", "Zlib"],
    "BSL-1.0": ["Boost Software License", "Boost Software License 1.0", "BSL-1.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL version 2", "GPLv2", "GPL v2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL version 3", "GPLv3", "GPL v3", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPLv2.1", "LGPL-2.1-or-later", "LGPL-3.0-only", "GNU Lesser General Public License v2.1"],
    "AGPL-3.0": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License", "EPL 2.0", "EPL-2.0"],
    "EUPL-1.2": ["European Union Public Licence", "EUPL 1.2", "EUPL-1.2"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License"],
    "public-domain": ["Unlicense", "CC0 1.0 Universal", "CC0-1.0"],
}
FORMS = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.",
    "distributed under the {}", "available under the {}", "subject to the terms of the {}", "SPDX-License-Identifier: {}", "License: {}",
]
# Sentences with licence words that are no licences.
OTHER = [
    "The driver must hold a valid license.", "The license plate was not readable.", "The fishing license costs four dollars a year.",
    "Permission was granted to leave the room early.", "The general public was invited to the open day.",
    "Version 2 of the story is better than version 3.", "The new version was released last week under the old name.",
    "All rights and wrongs were forgotten.", "The warranty covers two years.", "The copy shop is open to any person.",
    "He read the notice above the door.", "A member of the public domain committee resigned.", "The works were shown under the bridge.",
    "The conditions of the road are bad.", "Their software is free for schools.", "She is licensed to practise law.",
    "The city issued a business license to the owner of the shop.", "This book is about software and the people who use it.",
    "You may not enter the building without permission.", "The source of the river is subject to change.",
    "The program is free and open to the public.", "The author of the work was held liable for damages.",
    "A copy of the report is available at the office.", "The terms of the contract were published in January 2004.",
]


def phrases() -> list[tuple[str, str]]:
    """(family, text): all paragraphs, names in all forms, and the names of two and more words alone."""
    out = [(family, text) for family, texts in TEXTS.items() for text in texts]
    for family, names in NAMES.items():
        out += [(family, form.format(name)) for name in names for form in FORMS]
        out += [(family, name) for name in names if "License" in name or "Licence" in name]
    return out
