"""Licence texts and notices that files carry, and the phrases that each must have."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that must all stand in the aligned stretch, in this order.
    keys: tuple[str, ...]


# Published licence texts and notices, in their own words.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. """ + AS_IS

BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. """

BSD_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly
marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any
source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. """ + AS_IS

BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction
and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor."""

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""

GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed
in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the {name} for more details."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License {version} which is
available at"""

CDDL = """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may
not use this file except in compliance with the License."""

ARTISTIC = """This package is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"""

CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work
is published from. CC0 1.0 Universal public domain dedication"""

WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as
long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""

NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc", "4 0")),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa", "4 0")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("creative-commons", "this work is licensed under a creative commons attribution international license", ("creative commons attribution",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("epl-1.0", "licensed under the eclipse public license 1 0", ("eclipse public license", "1 0")),
    Template("epl-2.0", "licensed under the eclipse public license 2 0", ("eclipse public license", "2 0")),
    Template("cddl", "licensed under the common development and distribution license", ("common development and distribution license",)),
    Template("artistic", "licensed under the artistic license", ("artistic license",)),
    Template("zlib-notice", "released under the zlib license", ("zlib license",)),
    Template("bsd-notice", "released under the bsd license", ("bsd license",)),
    Template("isc-notice", "released under the isc license", ("isc license",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("mpl-2.0-notice", "licensed under the mpl 2 0", ("the mpl 2 0",)),
    Template("bsd-2-clause-notice", "released under the bsd 2 clause license", ("bsd 2 clause license",)),
    Template("bsd-3-clause-notice", "released under the bsd 3 clause license", ("bsd 3 clause license",)),
    Template("cc-by-4.0-notice", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0-notice", "creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    Template("cc-by-nc-4.0-notice", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-nc-sa-4.0-notice", "creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike 4 0",)),
    Template("cc-by-nd-4.0-notice", "creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives 4 0",)),
    Template("public-domain", "this file is placed in the public domain", ("in the public domain",)),
)

TEXTS = (
    Template("mit-text", MIT, ("permission is hereby granted free of charge", "shall be included in all copies", "the software is provided as is")),
    Template("bsd-2-clause-text", BSD_CONDITIONS + BSD_DISCLAIMER, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "as is and any express or implied warranties")),
    Template("bsd-3-clause-text", BSD_CONDITIONS + BSD_ENDORSEMENT + BSD_DISCLAIMER, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "endorse or promote products derived from this software", "as is and any express or implied warranties")),
    Template("isc-text", ISC, ("with or without fee is hereby granted", "appear in all copies", "the software is provided as is")),
    Template("zlib-text", ZLIB, ("will the authors be held liable", "altered source versions must be plainly marked", "may not be removed or altered from any source distribution")),
    Template("unlicense-text", UNLICENSE, ("free and unencumbered software", "in jurisdictions that recognize copyright laws", "the software is provided as is")),
    Template("bsl-1.0-text", BOOST, ("any person or organization obtaining a copy", "machine executable object code")),
    Template("apache-2.0-header", APACHE, ("licensed under the apache license version 2 0", "see the license for the specific language governing permissions")),
    *(
        Template(f"{label}-{version}-header", GPL_HEADER.format(name=name, version=version.partition(".")[0]), (f"under the terms of the {name.lower()}", f"either version {version.partition('.')[0]} of the license", "in the hope that it will be useful"))
        for label, name, versions in (("gpl", "GNU General Public License", ("2.0", "3.0")), ("lgpl", "GNU Lesser General Public License", ("3.0",)), ("agpl", "GNU Affero General Public License", ("3.0",)))
        for version in versions
    ),
    Template("mpl-2.0-header", MPL, ("subject to the terms of the mozilla public license v 2 0", "was not distributed with this file")),
    Template("epl-2.0-header", EPL.format(version="2.0"), ("this program and the accompanying materials", "eclipse public license 2 0")),
    Template("epl-1.0-header", EPL.format(version="v1.0"), ("this program and the accompanying materials", "eclipse public license v1 0")),
    Template("cddl-header", CDDL, ("subject to the terms of the common development and distribution license", "except in compliance with the license")),
    Template("artistic-2.0-header", ARTISTIC, ("under the terms of the artistic license 2 0",)),
    Template("cc0-1.0-notice", CC0, ("has waived all copyright and related or neighboring rights",)),
    Template("wtfpl-text", WTFPL, ("do what the fuck you want to public license",)),
)

# Identifiers of the public list of short licence names, each named by its own tag line.
SPDX = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear
BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later
ISC LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0
OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()

#: What a tag line begins with; its template goes on with one identifier, and :func:`licenses.scan` reads the expression.
TAG = "spdx license identifier"
TAGS = tuple(Template(f"spdx:{name.lower()}", f"SPDX-License-Identifier: {name}", (f"{TAG} {name}",)) for name in SPDX)

#: All that a scan looks for.
TEMPLATES = NOTICES + TEXTS + TAGS
