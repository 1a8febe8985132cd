"""Wording of licenses and notices, in template markup: (label, template).

<<beginOptional>> ... <<endOptional>> may be missing, <<var;name=...;max=n>> stands for up to n words.
"""

from __future__ import annotations

AS_IS = """the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
 warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the
 <<var;name=holders;max=12>> be liable for any claim, damages or other liability, whether in an action of contract, tort or
 otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."""
BSD_CONDITIONS = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the
 following conditions are met: <<var;name=bullet;max=1>> redistributions of source code must retain the above copyright notice,
 this list of conditions and the following disclaimer. <<var;name=bullet;max=1>> redistributions in binary form must reproduce
 the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
 provided with the distribution."""
BSD_NAME = """<<var;name=bullet;max=1>> neither the name of <<var;name=holder;max=12>> nor the names of
 <<var;name=its;max=2>> contributors may be used to endorse or promote products derived from this software without specific
 prior written permission."""
BSD_DISCLAIMER = """this software is provided by <<var;name=holders;max=12>> "as is" and any express or implied warranties,
 including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.
 in no event shall <<var;name=holders;max=12>> be liable for any direct, indirect, incidental, special, exemplary, or
 consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or
 profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or
 tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the
 possibility of such damage."""

# The wording of the licenses and notices.
WHOLE = [
    ("mit", f"""permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the <<var;name=quote;max=2>> software <<beginOptional>>or materials<<endOptional>>), to deal in the
     software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
     sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject
     to the following conditions: the above copyright notice and this permission notice
     <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of
     the software. {AS_IS}"""),
    ("isc", """permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> distribute this software for any purpose
     with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
     copies. the software is provided "as is" and <<var;name=author;max=12>> disclaims all warranties with regard to this
     software including all implied warranties of merchantability and fitness. in no event shall <<var;name=author;max=12>> be
     liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use,
     data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection
     with the use or performance of this software."""),
    ("bsd-2-clause", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{BSD_CONDITIONS} {BSD_NAME} {BSD_DISCLAIMER}"),
    ("zlib", """this software is provided 'as-is', without any express or implied warranty. in no event will the
     <<var;name=authors;max=4>> be held liable for any damages arising from the use of this software. permission is granted to
     anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
     freely, subject to the following restrictions: <<var;name=bullet;max=1>> the origin of this software must not be
     misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an
     acknowledgment in the product documentation would be appreciated but is not required. <<var;name=bullet;max=1>> altered
     source versions must be plainly marked as such, and must not be misrepresented as being the original software.
     <<var;name=bullet;max=1>> this notice may not be removed or altered from any source distribution."""),
    ("apache-2.0", """licensed under the apache license, version 2.0 (the <<beginOptional>>"<<endOptional>>license); you may not
     use this file except in compliance with the license. you may obtain a copy of the license at
     <<var;name=scheme;max=1>> www.apache.org/licenses/license-2.0 <<var;name=extension;max=1>> unless required by applicable
     law or agreed to in writing, software distributed under the license is distributed on an "as is" basis, without warranties
     or conditions of any kind, either express or implied. see the license for the specific language governing permissions and
     limitations under the license."""),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was
     not distributed with this file, you can obtain one at <<var;name=scheme;max=1>> mozilla.org/mpl/2.0"""),
]
#: The GNU licenses: label, name between "gnu" and "public license", versions of its notice.
GNU = [("gpl", "general", ("2", "3")), ("lgpl", "lesser general", ("2.1", "3")), ("agpl", "affero general", ("3",))]
#: Creative Commons licenses as in their names, their versions, and the words after the version.
CC_PARTS = {"by": "attribution", "nc": "noncommercial", "sa": "sharealike", "nd": "noderivatives"}
CC = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
#: Licenses that an SPDX line may name.
SPDX = ["mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "apache-2.0", "mpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0",
        *(f"cc-{part}-{version}" for part in CC for version in CC_VERSIONS)]


def gnu_notice(name: str, version: str) -> str:
    return f"""is free software <<var;name=mark;max=1>> you can redistribute it and/or modify it under the terms of the gnu {name}
     public license as published by the free software foundation; either version {version} of the license, or (at your option)
     any later version. <<var;name=program;max=8>> is distributed in the hope that it will be useful, but without any warranty;
     without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {name} public license
     for more details."""


def templates() -> list[tuple[str, str]]:
    """All of them; a whole wording, a notice or an SPDX line has the license as its label, a mere name has `...-name`."""
    out = list(WHOLE)
    out += [(f"{label}-{v if '.' in v else v + '.0'}-or-later", gnu_notice(name, v)) for label, name, versions in GNU for v in versions]
    for part in CC:
        words = " ".join(CC_PARTS[p] for p in part.split("-"))
        for v in CC_VERSIONS:
            out.append((f"cc-{part}-{v}", f"licensed under <<var;name=article;max=1>> creative commons {words} {v} <<beginOptional>>international<<endOptional>> <<beginOptional>>unported<<endOptional>> license"))
            out.append((f"cc-{part}-{v}", f"cc {part} {v}"))
    out += [(x, f"spdx-license-identifier: {x}") for x in SPDX]
    out += [
        ("mit-name", "<<beginOptional>>the <<endOptional>>mit license"),
        ("apache-2.0-name", "apache license<<beginOptional>>,<<endOptional>> <<beginOptional>>version<<endOptional>> 2.0"),
        ("gpl-3.0-name", "gnu <<beginOptional>>affero<<endOptional>> general public license<<beginOptional>>,<<endOptional>> version 3"),
        ("cc-by-nc", "cc by nc <<var;name=version;max=2>>"),
        ("cc-by-sa", "cc by sa <<var;name=version;max=2>>"),
    ]
    return out
