"""Signature rules of licences, written by hand.

A rule is a line of four fields, two spaces or more apart: label, priority, a
keyword that each of its matches holds, and a pattern over lower-cased words
joined by one space (punctuation is gone: "Version 2.0" reads "version 2 0").
Priorities: 20 a hint, 40 a bare name, 55 a name with its version, 60 an
address, 75 a grant or notice, 90 an identifier tag.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


#: Plain phrases whose every place is counted and whose labels always stay.
BASE = """
gpl  40  general public license  gnu general public license
apache  40  apache license  apache license
cc-by  40  cc by  cc by
mit  40  mit license  mit license
"""

GNU = """
gpl-1.0  55  general public license  gnu general public license (?:version|v) ?1(?: 0)?
gpl-2.0  55  general public license  gnu general public license (?:as published by the free software foundation )?(?:version|v) ?2(?: 0)?
gpl-3.0  55  general public license  gnu general public license (?:as published by the free software foundation )?(?:version|v) ?3(?: 0)?
gpl-2.0  55  gpl  (?:gnu )?gpl ?(?:version |v)?2(?: 0)?(?: only)?
gpl-3.0  55  gpl  (?:gnu )?gpl ?(?:version |v)?3(?: 0)?(?: only)?
gpl-2.0-or-later  75  general public license  gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later  75  general public license  gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0  75  version 2  released under (?:the )?(?:terms of )?(?:the )?gnu (?:gpl|general public license) version 2
gpl-3.0  75  version 3  released under (?:the )?(?:terms of )?(?:the )?gnu (?:gpl|general public license) version 3
gpl-2.0-or-later  60  gpl  gpl ?v?2(?: 0)? (?:plus|or later|or any later version)
gpl-3.0-or-later  60  gpl  gpl ?v?3(?: 0)? (?:plus|or later|or any later version)
gpl-2.0  60  gnu org  gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0  60  gnu org  gnu org licenses gpl 3 0
gpl  60  gnu org  gnu org (?:copyleft|licenses) gpl
gpl  75  gnu general public  you should have received a copy of the gnu general public license
gpl  75  warranty  without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl  75  under the terms of the gnu  (?:redistribute it and or modify it|distributed|released|licensed) under the terms of the gnu general public license
lgpl  40  lesser general public  gnu lesser general public license
lgpl  40  library general public  gnu library general public license
lgpl  40  lgpl  (?:gnu )?lgpl
lgpl-2.0  55  library general public  gnu library general public license (?:version|v) ?2(?: 0)?
lgpl-2.1  55  lesser general public  gnu lesser general public license (?:version|v) ?2 1
lgpl-3.0  55  lesser general public  gnu lesser general public license (?:version|v) ?3(?: 0)?
lgpl-2.1  55  lgpl  lgpl ?(?:version |v)?2 1
lgpl-3.0  55  lgpl  lgpl ?(?:version |v)?3(?: 0)?
lgpl-2.1-or-later  75  lesser general public  gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later  75  lesser general public  gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl  75  gnu lesser  you should have received a copy of the gnu lesser general public license
lgpl-2.1  60  gnu org  gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0  60  gnu org  gnu org licenses lgpl 3 0
agpl  40  affero  (?:gnu )?affero general public license
agpl  40  agpl  (?:gnu )?agpl
agpl-1.0  55  affero  affero general public license (?:version|v) ?1(?: 0)?
agpl-3.0  55  affero  (?:gnu )?affero general public license (?:version|v) ?3(?: 0)?
agpl-3.0  55  agpl  agpl ?(?:version |v)?3(?: 0)?
agpl-3.0-or-later  75  affero  gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0  60  gnu org  gnu org licenses agpl 3 0
gfdl  40  free documentation  gnu free documentation license
gfdl  40  gfdl  (?:gnu )?gfdl
gfdl-1.1  55  free documentation  gnu free documentation license version 1 1
gfdl-1.2  55  free documentation  gnu free documentation license version 1 2
gfdl-1.3  55  free documentation  gnu free documentation license version 1 3
gfdl-1.3  60  gnu org  gnu org licenses fdl 1 3
classpath-exception  75  independent module  as a special exception the copyright holders of this library give you permission to link this library with independent modules
classpath-exception  55  classpath exception  (?:gnu )?classpath exception(?: 2 0)?
gcc-exception  55  runtime library exception  gcc runtime library exception(?: version 3 1)?
font-exception  75  font  as a special exception if you create a document which uses this font
autoconf-exception  75  autoconf  as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts that are the output of autoconf
linking-exception  75  openssl  as a special exception [^ ]+(?: [^ ]+){0,8} permission to link (?:the code of )?[^ ]+(?: [^ ]+){0,6} with the openssl
"""

APACHE_MIT_BSD = """
apache-1.0  55  apache license  apache license (?:version|v) ?1 0
apache-1.1  55  apache  apache (?:software )?license (?:version|v) ?1 1
apache-2.0  55  apache license  apache license (?:version |v)?2(?: 0)?
apache-2.0  55  apache  apache (?:software )?(?:license )?v?2 0
apache-2.0  75  apache license  licensed under the apache license version 2 0(?: the license)?
apache-2.0  75  apache license  you may not use this file except in compliance with the license you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0(?: [^ ]+){0,60} apache license
apache-2.0  75  except in compliance  you may not use this file except in compliance with the license
apache-2.0  60  apache org  apache org licenses license 2 0
apache-1.1  60  apache org  apache org licenses license 1 1
apache-2.0  75  as is basis  distributed on an as is basis without warranties or conditions of any kind either express or implied
apache  40  apache software license  (?:the )?apache software license
apache-1.1  75  apache software foundation  this product includes software developed by the apache software foundation
llvm-exception  55  llvm  (?:apache 2 0 with )?llvm exceptions?
mit  55  mit  the mit license mit
mit  55  expat  (?:the )?expat license
mit  75  mit license  (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit license
mit  75  free of charge  permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit  75  shall be included  the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit  75  sell copies  rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit  60  opensource org  opensource org licenses mit(?: license)?
mit-0  55  mit no attribution  mit no attribution(?: license)?
x11  55  x11  x11 license
x11  75  x consortium  name of the x consortium shall not be used in advertising
mit-modern  75  mit modern  mit modern variant license
bsd  40  bsd  bsd(?: style)? licen[cs]e
bsd-2-clause  55  bsd  (?:simplified|freebsd|2 clause|two clause) bsd(?: license)?
bsd-2-clause  55  bsd  bsd 2 clause(?: license)?
bsd-3-clause  55  bsd  (?:new|revised|modified|3 clause|three clause) bsd(?: license)?
bsd-3-clause  55  bsd  bsd 3 clause(?: license)?
bsd-4-clause  55  bsd  (?:original|4 clause|four clause) bsd(?: license)?
bsd-4-clause  55  bsd  bsd 4 clause(?: license)?
bsd-0-clause  55  0bsd  0bsd
bsd-0-clause  55  bsd  (?:zero clause|0 clause) bsd(?: license)?
bsd  75  redistribution and use  redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause  75  endorse or promote  neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors may be used to endorse or promote products
bsd-4-clause  75  advertising materials  all advertising materials mentioning features or use of this software must display
bsd-3-clause  60  opensource org  opensource org licenses bsd 3 clause
bsd-2-clause  60  opensource org  opensource org licenses bsd 2 clause
bsd  60  opensource org  opensource org licenses bsd license
bsd  75  license that can be found  governed by a bsd style license that can be found in the license file
isc  40  isc  isc license
isc  75  for any purpose  permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc  60  opensource org  opensource org licenses isc
zlib  40  zlib  zlib(?: libpng)? license
zlib  75  as is  this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib  75  misrepresented  the origin of this software must not be misrepresented
libpng  40  libpng  libpng license
boost  40  boost  boost software license
boost-1.0  55  boost  boost software license version 1 0
boost-1.0  60  boost org  boost org license 1 0
unlicense  40  unlicense  the unlicense
unlicense  60  unlicense org  unlicense org
unlicense  75  public domain  this is free and unencumbered software released into the public domain
wtfpl  40  wtfpl  wtfpl
wtfpl  75  the fuck you want  do what the fuck you want to public license
beerware  75  beer  you can buy me a beer in return
beerware  40  beerware  beerware license
curl  55  curl license  curl license
ntp  75  ntp  ntp license
hpnd  75  historical permission  historical permission notice and disclaimer
ncsa  40  ncsa  (?:university of illinois )?ncsa open source license
postgresql  40  postgresql  postgresql licen[cs]e
python-2.0  55  python  python software foundation license(?: version 2)?
python-2.0  55  psf  psf license(?: agreement)?
php-3.01  55  php  php license(?: version)? 3 01
php  40  php  php license
php  60  php net  php net license
ruby  55  ruby  ruby license
openssl  40  openssl  openssl license
openssl  75  openssl  this product includes software developed by the openssl project
zpl-2.1  55  zope  zope public license(?: zpl)? version 2 1
zpl  40  zope  zope public license
unicode  40  unicode  unicode(?: inc)? license agreement
icu  55  icu  icu license
vim  55  vim  vim license
tcl  55  tcl  tcl tk license
artistic  40  artistic  artistic license
artistic-1.0  55  artistic  artistic license (?:version )?1 0
artistic-2.0  55  artistic  artistic license (?:version )?2 0
artistic  75  perl  under the same terms as perl itself
afl-3.0  55  academic free  academic free license (?:version |v)?3 0
afl  40  academic free  academic free license
ecl-2.0  55  educational community  educational community license (?:version )?2 0
ms-pl  40  microsoft public  microsoft public license
ms-rl  40  microsoft reciprocal  microsoft reciprocal license
"""

WEAK_COPYLEFT = """
mpl  40  mozilla public  mozilla public license
mpl-1.1  55  mozilla public  mozilla public license (?:version|v) ?1 1
mpl-2.0  55  mozilla public  mozilla public license (?:version |v)?2 0
mpl-2.0  55  mpl  mpl ?(?:version |v)?2(?: 0)?
mpl-2.0  60  mozilla org  mozilla org mpl 2 0
mpl-1.1  60  mozilla org  mozilla org mpl mpl 1 1
mpl-2.0  75  mozilla public  this source code form is subject to the terms of the mozilla public license v ?2 0
mpl-1.1  75  mozilla public  the contents of this file are subject to the mozilla public license version 1 1
epl  40  eclipse public  eclipse public license
epl-1.0  55  eclipse public  eclipse public license (?:version |v)?1 0
epl-2.0  55  eclipse public  eclipse public license (?:version |v)?2 0
epl-1.0  60  eclipse org  eclipse org legal epl v10
epl-2.0  60  eclipse org  eclipse org legal epl (?:2 0|v20)
edl-1.0  55  eclipse distribution  eclipse distribution license (?:version |v)?1 0
cpl-1.0  55  common public license  common public license(?: version 1 0)?
ipl-1.0  55  ibm public  ibm public license(?: version 1 0)?
cddl  40  common development  common development and distribution license
cddl-1.0  55  common development  common development and distribution license (?:cddl )?(?:version |v)?1 0
cddl-1.1  55  common development  common development and distribution license (?:cddl )?(?:version |v)?1 1
cddl  40  cddl  cddl(?: license)?
eupl  40  european union public  european union public licen[cs]e
eupl-1.1  55  eupl  eupl (?:v ?)?1 1
eupl-1.2  55  eupl  eupl (?:v ?)?1 2
cecill  40  cecill  cecill(?: b| c)?(?: free software)? licen[cs]e
osl-3.0  55  open software license  open software license (?:version |v)?3 0
osl  40  open software license  open software license
qpl-1.0  55  q public license  q public license(?: version 1 0)?
apsl-2.0  55  apple public source  apple public source license(?: version 2 0)?
spl-1.0  55  sun public  sun public license(?: version 1 0)?
lppl  40  latex project  latex project public license
lppl-1.3c  55  latex project  latex project public license (?:version )?1 3c?
ofl  40  open font  (?:sil )?open font license
ofl-1.1  55  open font  (?:sil )?open font license version 1 1
ofl-1.1  60  scripts sil org  scripts sil org ofl
cpal-1.0  55  common public attribution  common public attribution license(?: version 1 0)?
nposl-3.0  55  non profit open software  non profit open software license(?: 3 0)?
rpl-1.5  55  reciprocal public  reciprocal public license(?: 1 5)?
sleepycat  55  sleepycat  sleepycat license
upl-1.0  55  universal permissive  universal permissive license(?: version 1 0)?
mulan-2.0  55  mulan  mulan psl v2
"""

CONTENT = """
cc  40  creative commons  creative commons(?: public)? licen[cs]e
cc0  40  cc0  cc0
cc0-1.0  55  cc0  cc0 1 0(?: universal)?
cc0-1.0  60  creativecommons org  creativecommons org publicdomain zero 1 0
cc0-1.0  75  waived all copyright  has waived all copyright and related (?:or|and) neighboring rights
cc-pdm  60  creativecommons org  creativecommons org publicdomain mark 1 0
cc-by  40  creative commons attribution  creative commons attribution(?: international)?(?: public)?(?: license)?
cc-by-1.0  55  cc by  cc by 1 0
cc-by-2.0  55  cc by  cc by 2 0
cc-by-2.5  55  cc by  cc by 2 5
cc-by-3.0  55  cc by  cc by 3 0
cc-by-4.0  55  cc by  cc by 4 0
cc-by-sa  50  cc by sa  cc by sa
cc-by-sa-2.0  55  cc by sa  cc by sa 2 0
cc-by-sa-2.5  55  cc by sa  cc by sa 2 5
cc-by-sa-3.0  55  cc by sa  cc by sa 3 0
cc-by-sa-4.0  55  cc by sa  cc by sa 4 0
cc-by-nd  50  cc by nd  cc by nd
cc-by-nd-3.0  55  cc by nd  cc by nd 3 0
cc-by-nd-4.0  55  cc by nd  cc by nd 4 0
cc-by-nc  50  cc by nc  cc by nc
cc-by-nc-2.0  55  cc by nc  cc by nc 2 0
cc-by-nc-3.0  55  cc by nc  cc by nc 3 0
cc-by-nc-4.0  55  cc by nc  cc by nc 4 0
cc-by-nc-sa  52  cc by nc sa  cc by nc sa
cc-by-nc-sa-3.0  55  cc by nc sa  cc by nc sa 3 0
cc-by-nc-sa-4.0  55  cc by nc sa  cc by nc sa 4 0
cc-by-nc-nd  52  cc by nc nd  cc by nc nd
cc-by-nc-nd-3.0  55  cc by nc nd  cc by nc nd 3 0
cc-by-nc-nd-4.0  55  cc by nc nd  cc by nc nd 4 0
cc-by-4.0  55  creative commons attribution  creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
cc-by-3.0  55  creative commons attribution  creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-4.0  55  creative commons attribution  creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-sa-3.0  55  creative commons attribution  creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-nc-4.0  55  creative commons attribution  creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
cc-by-nd-4.0  55  creative commons attribution  creative commons attribution no ?deriv(?:s|atives) 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-sa-4.0  55  creative commons attribution  creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: license)?
cc-by-nc-nd-4.0  55  creative commons attribution  creative commons attribution non ?commercial no ?deriv(?:s|atives) 4 0(?: international)?(?: public)?(?: license)?
cc-by-4.0  60  creativecommons org  creativecommons org licenses by 4 0
cc-by-3.0  60  creativecommons org  creativecommons org licenses by 3 0
cc-by-2.0  60  creativecommons org  creativecommons org licenses by 2 0
cc-by-sa-4.0  60  creativecommons org  creativecommons org licenses by sa 4 0
cc-by-sa-3.0  60  creativecommons org  creativecommons org licenses by sa 3 0
cc-by-nd-4.0  60  creativecommons org  creativecommons org licenses by nd 4 0
cc-by-nc-4.0  60  creativecommons org  creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0  60  creativecommons org  creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0  60  creativecommons org  creativecommons org licenses by nc nd 4 0
odbl-1.0  55  open database  open database license(?: odbl)?(?: v1 0)?
odc-by-1.0  55  open data commons  open data commons attribution license(?: v1 0)?
pddl-1.0  55  public domain dedication  (?:open data commons )?public domain dedication and license(?: pddl)?
cdla-permissive  55  community data license  community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing  55  community data license  community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk  55  open government  (?:uk )?open government licen[cs]e(?: v?[123](?: 0)?)?
etalab  55  licence ouverte  licence ouverte(?: open licence)?(?: version)?(?: 2 0)?
openrail  55  rail  (?:creativeml )?open ?rail(?: m)?(?: license)?
opl-1.0  55  open publication  open publication license(?: v1 0)?
free-art-1.3  55  free art  free art license(?: 1 3)?
public-domain  40  public domain  (?:is|are|was|were|been) (?:[^ ]+ )?(?:in|into|to) the public domain
public-domain  75  public domain  (?:released|placed|dedicated|put) (?:[^ ]+ ){0,4}(?:in|into|to) the public domain
"""

RESTRICTED = """
bsl-1.1  55  business source  business source license(?: version)?(?: 1 1)?
sspl-1.0  55  server side public  server side public license(?: v(?:ersion )?1)?
elastic-2.0  55  elastic license  elastic license(?: version)?(?: 2 0)?
commons-clause  55  commons clause  commons clause(?: license)?(?: condition)?(?: v1 0)?
polyform-nc  55  polyform  polyform noncommercial license(?: 1 0 0)?
polyform  40  polyform  polyform (?:small business|shield|strict|perimeter|internal use) license
confluent  55  confluent  confluent community license
llama  55  llama  llama ?[234]?(?: 1| 2| 3)? community license(?: agreement)?
json  75  for good not evil  the software shall be used for good not evil
non-commercial  20  non commercial  for non commercial (?:use|purposes) only
non-commercial  20  noncommercial  for noncommercial (?:use|purposes) only
research-only  20  research  for (?:academic |scientific )?research (?:use|purposes) only
evaluation-only  20  evaluation  for evaluation (?:use|purposes) only
all-rights-reserved  20  all rights reserved  all rights reserved
all-rights-reserved  30  alle rechte  alle rechte vorbehalten
all-rights-reserved  30  tous droits  tous droits réservés
all-rights-reserved  30  todos los derechos  todos los derechos reservados
proprietary  30  proprietary  (?:proprietary and confidential|confidential and proprietary)
proprietary  30  may be reproduced  no part of this [^ ]+ may be reproduced
proprietary  30  unauthori  unauthori[sz]ed (?:copying|reproduction|distribution)(?: or distribution)?
eula  30  end user license  end user license agreement
eula  30  terms of use  subject to (?:the|our) terms of use
"""

#: Tags name a licence by its identifier; the text has lost hyphens and points, so each is spelt as it then reads.
TAGS = """
gpl-1.0  90  spdx  spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0  90  spdx  spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later  90  spdx  spdx license identifier gpl 2 0 or later
gpl-3.0  90  spdx  spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later  90  spdx  spdx license identifier gpl 3 0 or later
lgpl-2.1  90  spdx  spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later  90  spdx  spdx license identifier lgpl 2 1 or later
lgpl-3.0  90  spdx  spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later  90  spdx  spdx license identifier lgpl 3 0 or later
agpl-3.0  90  spdx  spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later  90  spdx  spdx license identifier agpl 3 0 or later
apache-2.0  90  spdx  spdx license identifier apache 2 0
mit  90  spdx  spdx license identifier mit
mit-0  90  spdx  spdx license identifier mit 0
isc  90  spdx  spdx license identifier isc
bsd-2-clause  90  spdx  spdx license identifier bsd 2 clause
bsd-3-clause  90  spdx  spdx license identifier bsd 3 clause
bsd-4-clause  90  spdx  spdx license identifier bsd 4 clause
bsd-0-clause  90  spdx  spdx license identifier 0bsd
mpl-1.1  90  spdx  spdx license identifier mpl 1 1
mpl-2.0  90  spdx  spdx license identifier mpl 2 0
epl-1.0  90  spdx  spdx license identifier epl 1 0
epl-2.0  90  spdx  spdx license identifier epl 2 0
cddl-1.0  90  spdx  spdx license identifier cddl 1 0
eupl-1.2  90  spdx  spdx license identifier eupl 1 2
boost-1.0  90  spdx  spdx license identifier bsl 1 0
bsl-1.1  90  spdx  spdx license identifier busl 1 1
unlicense  90  spdx  spdx license identifier unlicense
zlib  90  spdx  spdx license identifier zlib
ofl-1.1  90  spdx  spdx license identifier ofl 1 1
cc0-1.0  90  spdx  spdx license identifier cc0 1 0
cc-by-4.0  90  spdx  spdx license identifier cc by 4 0
cc-by-sa-4.0  90  spdx  spdx license identifier cc by sa 4 0
cc-by-nc-4.0  90  spdx  spdx license identifier cc by nc 4 0
"""


def read(block: str, base: bool = False) -> list[Rule]:
    lines = [re.split(" {2,}", line) for line in block.strip().splitlines()]
    return [Rule(label, int(priority), keyword, pattern, base) for label, priority, keyword, pattern in lines]


#: In order: of rules that agree in place and priority, the first one stands.
RULES = read(BASE, base=True) + [r for block in (GNU, APACHE_MIT_BSD, WEAK_COPYLEFT, CONTENT, RESTRICTED, TAGS) for r in read(block)]
