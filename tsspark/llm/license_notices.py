"""The table of licence notices: name of the notice to its text. A change of the table raises ``VERSION``."""

from __future__ import annotations

VERSION = 2

#: Notices of five words or more. The lines "Apache-2.0", "MIT", "GPL-3.0" and "CC-BY-NC-4.0" are the ones that the given documents hold.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-binary-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-third-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-advertising-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "BSD-style-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-style-notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-1.0-notice": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "MPL-2.0-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-1.1-notice": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "CDDL-1.0-notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.",
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-only-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GNU-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "EUPL-notice": "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission - subsequent versions of the EUPL",
    "WTFPL-text": "This program is free software. It comes without any warranty, to the extent permitted by applicable law.",
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Artistic-2.0-notice": "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
}

_BY = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC = ("1.0", "2.0", "2.5", "3.0", "4.0")
_AREAS = {"2.0": "Generic", "3.0": "Unported", "4.0": "International"}
for _code, _words in _BY.items():
    for _version, _area in _AREAS.items():
        TEMPLATES.setdefault(f"CC-{_code}-{_version}" + "-text" * (_code == "BY-NC"), f"This work is licensed under a Creative Commons {_words} {_version} {_area} License.")

_SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2",
    "GFDL-1.3", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.0", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT",
    "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Unlicense", "UPL-1.0",
    "Vim", "WTFPL", "X11", "Zlib", *(f"CC-{c}-{v}" for c in _BY for v in _CC),
]
#: Notices of under five words, which must match word for word: names of licences, SPDX lines, addresses.
SHORT = {f"SPDX {x}": f"SPDX-License-Identifier: {x}" for x in _SPDX}
SHORT |= {f"CC-{c}-{v} name": f"CC {c} {v}" for c in _BY for v in _CC}
SHORT |= {f"CC-{c}-{v} id": f"CC-{c}-{v}" for c in _BY for v in _CC}
SHORT |= {f"CC-{c}-{v} {s}": f"{s}://creativecommons.org/licenses/{c.lower()}/{v}" for c in _BY for v in _CC for s in ("http", "https")}
SHORT |= {
    "MIT name": "MIT License", "Expat name": "Expat License", "ISC name": "ISC License", "Zlib name": "zlib License", "BSD name": "BSD License",
    "BSD-2-Clause name": "BSD 2-Clause License", "BSD-2-Clause simplified": "Simplified BSD License", "BSD-3-Clause name": "BSD 3-Clause License",
    "BSD-3-Clause revised": "Revised BSD License", "BSD-3-Clause new": "New BSD License", "Apache name": "Apache License", "Apache-2.0 name": "Apache License 2.0",
    "Apache-2.0 version": "Apache License, Version 2.0", "GPL name": "GNU General Public License", "LGPL name": "GNU Lesser General Public", "GPL short": "GNU GPL",
    "LGPL short": "GNU LGPL", "AGPL name": "GNU Affero General Public", "AGPL short": "GNU AGPL", "GFDL name": "GNU Free Documentation License",
    "LGPL library name": "GNU Library General Public", "MPL name": "Mozilla Public License", "EPL name": "Eclipse Public License", "BSL name": "Boost Software License",
    "CC0-1.0 name": "CC0 1.0 Universal", "CC0-1.0 short": "CC0 1.0", "CC0-1.0 id": "CC0-1.0", "CC0-1.0 http": "http://creativecommons.org/publicdomain/zero/1.0",
    "CC0-1.0 https": "https://creativecommons.org/publicdomain/zero/1.0", "Unlicense name": "The Unlicense", "EUPL name": "European Union Public Licence",
    "OFL name": "SIL Open Font License", "CDDL name": "Common Development and Distribution", "Artistic name": "Artistic License", "WTFPL name": "WTFPL",
}
