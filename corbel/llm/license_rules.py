"""Signature rules for licences, in order: a rule before another wins where both match the same text.

Each line has the licence, the rule's class, its keywords (all must be in the
text, in small letters, where the pattern implies them) and its pattern. A blank in a pattern stands for white
space, also with comment marks between lines; case doesn't matter.
"""

RULES = r"""
Apache-2.0 | notice | apache+licen | Licensed under the Apache Licen[sc]e,? Version 2(?:\.0)?(?: \(the "License"\))?
Apache-2.0 | notice | apache+licen | (?:released|distributed|available|provided) under the (?:terms of the )?Apache(?: Software)?(?: Foundation)? Licen[sc]e,? (?:Version |v\.? ?)?2(?:\.0)?
Apache-2.0 | text | apache+terms | TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1\. Definitions
Apache-2.0 | title | apache+licen | Apache Licen[sc]e,? (?:\(?Version |v\.? ?)?2(?:\.0)?
Apache-2.0 | name | apache | \bApache[- ]2(?:\.0)?\b
Apache-2.0 | url | apache.org | https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.txt|\.html)?
Apache-1.1 | title | apache+1.1 | Apache Software License,? Version 1\.1
Apache-1.1 | url | apache.org | https?://(?:www\.)?apache\.org/licenses/LICENSE-1\.1
Apache-1.0 | title | apache+1.0 | Apache (?:Software )?License,? Version 1\.0
Apache-1.1 | text | apache+acknowledg | This product includes software developed by the Apache Software Foundation
MIT | text | permission+charge | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "Software"\), to deal in the Software without restriction
MIT | notice | mit+licen | (?:released|licensed|distributed|available|provided) under the (?:terms of the )?MIT(?:/X11)? Licen[sc]e
MIT | notice | mit+licen | (?:released|licensed|distributed|available) under (?:an? )?MIT(?:-style)? licen[sc]e
MIT | title | mit+licen | \bThe MIT License(?: \(MIT\))?
MIT | title | mit+licen | \bMIT Licen[sc]e\b
MIT | name | mit+licen | Licen[sc]e: MIT\b
MIT | url | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
MIT | url | mit-license.org | https?://(?:www\.)?mit-license\.org
MIT-0 | title | mit+attribution | MIT No Attribution
MIT-0 | url | aws/mit-0 | https?://github\.com/aws/mit-0
X11 | text | consortium | Except as contained in this notice, the name of the X Consortium shall not be used
X11 | title | x11+licen | \bX11 License\b
ISC | text | permission+purpose | Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
0BSD | text | permission+purpose | Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.(?! provided)
ISC | notice | isc+licen | (?:released|licensed|distributed|available) under the (?:terms of the )?ISC Licen[sc]e
ISC | title | isc+licen | \bISC Licen[sc]e\b
ISC | url | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/isc(?:-license)?(?:\.txt|\.php)?
0BSD | title | zero+clause | (?:BSD )?Zero[- ]Clause(?: BSD)? License
0BSD | title | 0bsd | \b0BSD\b
BSD-4-Clause | text | redistribution+advertising | All advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD-4-Clause-UC | text | redistribution+berkeley | This product includes software developed by the University of California, Berkeley and its contributors
BSD-3-Clause | text | redistribution+endorse | Neither the names? of .{1,120}? nor the names of (?:its|their|other|any) contributors may be used to endorse or promote products derived from this software
BSD-3-Clause | text | redistribution+endorse | The names? of (?:the author|.{1,80}?) may not be used to endorse or promote products derived from this software
BSD-3-Clause-Clear | text | redistribution+patent | NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'?S PATENT RIGHTS ARE GRANTED BY THIS LICENSE
BSD-2-Clause | text | redistribution+binary | Redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met
BSD-3-Clause | notice | bsd+licen | (?:released|licensed|distributed|available|governed) (?:under|by) (?:the |an? )?(?:terms of the )?(?:3-clause|new|modified|revised|three-clause) BSD(?:-style)? licen[sc]e
BSD-2-Clause | notice | bsd+licen | (?:released|licensed|distributed|available|governed) (?:under|by) (?:the |an? )?(?:terms of the )?(?:2-clause|simplified|two-clause|FreeBSD) (?:BSD )?licen[sc]e
BSD-unspecified | notice | bsd+licen | (?:released|licensed|distributed|available|governed) (?:under|by) (?:the |an? )?(?:terms of the )?BSD(?:-style)? licen[sc]e
BSD-3-Clause | title | bsd+clause | \bBSD 3-Clause(?: (?:"New" or "Revised"|Revised|New))?(?: Licen[sc]e)?|\b3-Clause BSD(?: Licen[sc]e)?
BSD-2-Clause | title | bsd+clause | \bBSD 2-Clause(?: (?:"Simplified"|Simplified))?(?: Licen[sc]e)?|\b2-Clause BSD(?: Licen[sc]e)?
BSD-4-Clause | title | bsd+clause | \bBSD 4-Clause|\b4-Clause BSD|\bOriginal BSD Licen[sc]e
BSD-3-Clause | title | bsd | \b(?:New|Modified|Revised) BSD Licen[sc]e
BSD-2-Clause | title | bsd | \bSimplified BSD Licen[sc]e|\bFreeBSD Licen[sc]e
BSD-unspecified | name | bsd+licen | \bBSD(?:-style)? Licen[sc]e
BSD-3-Clause | url | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause
BSD-2-Clause | url | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause
BSD-unspecified | url | opensource.org | https?://(?:www\.)?opensource\.org/licenses?/bsd-license(?:\.php)?
BSD-1-Clause | title | bsd+clause | \bBSD 1-Clause|\b1-Clause BSD
BSD-3-Clause-LBNL | title | lawrence+berkeley | Lawrence Berkeley National Labs BSD
AGPL-3.0-or-later | notice | affero+later | GNU Affero General Public License(?: as published by the Free Software Foundation)?,? (?:either )?version 3(?: of the License)?,? or \(?at your option\)? any later version
AGPL-3.0-only | notice | affero | (?:under|of) the (?:terms of the )?GNU Affero General Public License,? (?:version |v\.? ?)3
AGPL-3.0-only | text | affero+19 | GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
AGPL-1.0-only | text | affero+2002 | AFFERO GENERAL PUBLIC LICENSE Version 1, March 2002
AGPL-3.0-only | title | affero | GNU Affero General Public License,? (?:version |v\.? ?)?3(?:\.0)?
AGPL-unspecified | title | affero | \b(?:GNU )?Affero General Public License
AGPL-3.0-only | name | agpl | \bAGPL[- ]?v?3(?:\.0)?\b
AGPL-unspecified | name | agpl | \bAGPL\b
AGPL-3.0-only | url | gnu.org | https?://(?:www\.)?gnu\.org/licenses/agpl(?:-3\.0)?(?:\.html|\.txt|\.en\.html)?
LGPL-3.0-or-later | notice | lesser+later | GNU Lesser General Public License(?: as published by the Free Software Foundation)?[,;]? (?:either )?version 3(?: of the License)?,? or \(?at your option\)? any later version
LGPL-2.1-or-later | notice | lesser+later | GNU Lesser General Public License(?: as published by the Free Software Foundation)?[,;]? (?:either )?version 2\.1(?: of the License)?,? or \(?at your option\)? any later version
LGPL-2.0-or-later | notice | library+later | GNU Library General Public License(?: as published by the Free Software Foundation)?[,;]? (?:either )?version 2(?: of the License)?,? or \(?at your option\)? any later version
LGPL-3.0-only | notice | lesser | (?:under|of) the (?:terms of the )?GNU Lesser General Public License,? (?:version |v\.? ?)3
LGPL-2.1-only | notice | lesser | (?:under|of) the (?:terms of the )?GNU Lesser General Public License,? (?:version |v\.? ?)2\.1
LGPL-3.0-only | text | lesser+29 | GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
LGPL-2.1-only | text | lesser+1999 | GNU LESSER GENERAL PUBLIC LICENSE Version 2\.1, February 1999
LGPL-2.0-only | text | library+1991 | GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991
LGPL-3.0-only | title | lesser | GNU Lesser General Public License,? (?:version |v\.? ?)?3(?:\.0)?
LGPL-2.1-only | title | lesser | GNU Lesser General Public License,? (?:version |v\.? ?)?2\.1
LGPL-2.0-only | title | library | GNU Library General Public License,? (?:version |v\.? ?)?2(?:\.0)?
LGPL-unspecified | title | general+public | GNU (?:Lesser|Library) General Public License
LGPL-3.0-only | name | lgpl | \bLGPL[- ]?v?3(?:\.0)?\b
LGPL-2.1-only | name | lgpl | \bLGPL[- ]?v?2\.1\b
LGPL-2.0-only | name | lgpl | \bLGPL[- ]?v?2(?:\.0)?\b(?!\.1)
LGPL-unspecified | name | lgpl | \bLGPL\b
LGPL-3.0-only | url | gnu.org | https?://(?:www\.)?gnu\.org/licenses/lgpl(?:-3\.0)(?:\.html|\.txt|\.en\.html)?
LGPL-2.1-only | url | gnu.org | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.html|\.txt|\.en\.html)?
GPL-3.0-or-later | notice | gnu+later | GNU General Public License(?: as published by the Free Software Foundation)?[,;]? (?:either )?version 3(?: of the License)?,? or \(?at your option\)? any later version
GPL-2.0-or-later | notice | gnu+later | GNU General Public License(?: as published by the Free Software Foundation)?[,;]? (?:either )?version 2(?: of the License)?,? or \(?at your option\)? any later version
GPL-3.0-only | notice | gnu+general | This (?:program|work|library|software|file) is (?:free software|licensed)[,:;]? .{0,80}?under the (?:terms of the )?GNU General Public License,? (?:version |v\.? ?)3(?:\.0)?
GPL-2.0-only | notice | gnu+general | This (?:program|work|library|software|file) is (?:free software|licensed)[,:;]? .{0,80}?under the (?:terms of the )?GNU General Public License,? (?:version |v\.? ?)2(?:\.0)?
GPL-3.0-only | notice | gnu+general | (?:licensed|released|distributed|available|modify it|covered) (?:under|by) the (?:terms of the )?GNU (?:General Public License|GPL),? (?:version |v\.? ?)3(?:\.0)?
GPL-2.0-only | notice | gnu+general | (?:licensed|released|distributed|available|modify it|covered) (?:under|by) the (?:terms of the )?GNU (?:General Public License|GPL),? (?:version |v\.? ?)2(?:\.0)?
GPL-3.0-only | text | gnu+29 | GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
GPL-2.0-only | text | gnu+1991 | GNU GENERAL PUBLIC LICENSE Version 2, June 1991
GPL-1.0-only | text | gnu+1989 | GNU GENERAL PUBLIC LICENSE Version 1, February 1989
GPL-3.0-only | title | gnu+general | GNU General Public License,? (?:version |v\.? ?)?3(?:\.0)?\b
GPL-2.0-only | title | gnu+general | GNU General Public License,? (?:version |v\.? ?)?2(?:\.0)?\b
GPL-unspecified | notice | gnu+general | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:GNU )?(?:GPL|General Public License)\b
GPL-unspecified | title | gnu+general | GNU General Public License
GPL-3.0-only | name | gpl | \b(?:GNU )?GPL[- ]?v?3(?:\.0)?\b
GPL-2.0-only | name | gpl | \b(?:GNU )?GPL[- ]?v?2(?:\.0)?\b
GPL-unspecified | name | gpl | \bGNU GPL\b
GPL-3.0-only | url | gnu.org | https?://(?:www\.)?gnu\.org/licenses/gpl(?:-3\.0)(?:\.html|\.txt|\.en\.html)?
GPL-2.0-only | url | gnu.org | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.html|\.txt|\.en\.html)?
GPL-unspecified | url | gnu.org | https?://(?:www\.)?gnu\.org/licenses/(?:gpl\.html|gpl\.txt|gpl)?
GPL-2.0-with-classpath-exception | notice | classpath | (?:subject to the )?"?Classpath"? exception
GPL-3.0-with-GCC-exception | notice | gcc+exception | GCC Runtime Library Exception
GFDL-1.3-only | notice | documentation+license | GNU Free Documentation License,? Version 1\.3
GFDL-1.2-only | notice | documentation+license | GNU Free Documentation License,? Version 1\.2
GFDL-1.1-only | notice | documentation+license | GNU Free Documentation License,? Version 1\.1
GFDL-unspecified | title | documentation+license | GNU Free Documentation License
GFDL-unspecified | name | gfdl | \bGFDL\b
GFDL-unspecified | url | gnu.org | https?://(?:www\.)?gnu\.org/(?:copyleft|licenses)/fdl(?:-1\.\d)?(?:\.html)?
MPL-2.0 | notice | mozilla | subject to the terms of the Mozilla Public License,? v(?:ersion|\.)? ?2\.0
MPL-1.1 | notice | mozilla | subject to the Mozilla Public License Version 1\.1
MPL-2.0 | text | mozilla | Mozilla Public License Version 2\.0 =+
MPL-2.0 | title | mozilla | Mozilla Public License,? (?:Version |v\.? ?)?2(?:\.0)?
MPL-1.1 | title | mozilla | Mozilla Public License,? (?:Version |v\.? ?)?1\.1
MPL-1.0 | title | mozilla | Mozilla Public License,? (?:Version |v\.? ?)?1\.0
MPL-unspecified | title | mozilla | Mozilla Public License
MPL-2.0 | name | mpl | \bMPL[- ]?v?2(?:\.0)?\b
MPL-1.1 | name | mpl | \bMPL[- ]?v?1\.1\b
MPL-2.0 | url | mozilla.org | https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0/?
MPL-1.1 | url | mozilla.org | https?://(?:www\.)?mozilla\.org/MPL/(?:MPL-)?1\.1(?:\.html)?/?
EPL-2.0 | notice | eclipse | made available under the terms of the Eclipse Public License (?:v\.? ?|version )?2\.0
EPL-1.0 | notice | eclipse | made available under the terms of the Eclipse Public License (?:v\.? ?|version )?1\.0
EPL-2.0 | title | eclipse | Eclipse Public License,? (?:- )?(?:Version |v\.? ?)?2(?:\.0)?
EPL-1.0 | title | eclipse | Eclipse Public License,? (?:- )?(?:Version |v\.? ?)?1(?:\.0)?
EPL-2.0 | url | eclipse.org | https?://(?:www\.)?eclipse\.org/(?:legal|org/documents)/epl-(?:v20|2\.0)(?:\.html|/)?
EPL-1.0 | url | eclipse.org | https?://(?:www\.)?eclipse\.org/(?:legal|org/documents)/epl-v10(?:\.html|/)?
CPL-1.0 | title | common+public | Common Public License(?: Version 1\.0| 1\.0| v1\.0)?
CDDL-1.1 | title | common+development | COMMON DEVELOPMENT AND DISTRIBUTION LICENSE(?: \(CDDL\))? Version 1\.1
CDDL-1.0 | title | common+development | COMMON DEVELOPMENT AND DISTRIBUTION LICENSE(?: \(CDDL\))?(?: Version 1\.0)?
CDDL-1.0 | name | cddl | \bCDDL[- ]?(?:v?1(?:\.0)?)?\b
EUPL-1.2 | title | european+union | European Union Public Licen[sc]e,? (?:\(EUPL\) )?v(?:ersion|\.)? ?1\.2
EUPL-1.1 | title | european+union | European Union Public Licen[sc]e,? (?:\(EUPL\) )?v(?:ersion|\.)? ?1\.1
EUPL-1.2 | name | eupl | \bEUPL[- ]?(?:v\.? ?)?1\.2\b
EUPL-1.1 | name | eupl | \bEUPL[- ]?(?:v\.? ?)?1\.1\b
CC0-1.0 | notice | waived | To the extent possible under law, .{1,120}? has waived all copyright and related or neighbou?ring rights
CC0-1.0 | title | cc0 | \bCC0(?:[- ]1\.0)?(?: Universal)?(?: Public Domain Dedication)?
CC0-1.0 | title | creative+zero | Creative Commons Zero(?: v1\.0)?(?: Universal)?
CC0-1.0 | url | creativecommons.org | https?://creativecommons\.org/publicdomain/zero/1\.0/?(?:legalcode)?
PDM-1.0 | url | creativecommons.org | https?://creativecommons\.org/publicdomain/mark/1\.0/?
CC-BY-NC-ND-4.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY-NC-ND[- ]4\.0
CC-BY-NC-SA-4.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY-NC-SA[- ]4\.0
CC-BY-NC-4.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY-NC[- ]4\.0
CC-BY-ND-4.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY-ND[- ]4\.0
CC-BY-SA-4.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY-SA[- ]4\.0
CC-BY-4.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY[- ]4\.0
CC-BY-SA-3.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY-SA[- ]3\.0
CC-BY-3.0 | notice | licen+cc | licensed under (?:a |the )?CC[- ]BY[- ]3\.0
CC-BY-NC-ND-4.0 | title | creative+commons | Creative Commons Attribution[- ]Non-?Commercial[- ]No-?Deriv(?:ative)?s? (?:Works )?4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-NC-SA-4.0 | title | creative+commons | Creative Commons Attribution[- ]Non-?Commercial[- ]Share-?Alike 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-NC-4.0 | title | creative+commons | Creative Commons Attribution[- ]Non-?Commercial 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-ND-4.0 | title | creative+commons | Creative Commons Attribution[- ]No-?Deriv(?:ative)?s? (?:Works )?4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-SA-4.0 | title | creative+commons | Creative Commons Attribution[- ]Share-?Alike 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-4.0 | title | creative+commons | Creative Commons Attribution 4\.0(?: International)?(?: (?:Public )?License)?
CC-BY-NC-ND-3.0 | title | creative+commons | Creative Commons Attribution[- ]Non-?Commercial[- ]No-?Derivs? 3\.0(?: Unported)?
CC-BY-NC-SA-3.0 | title | creative+commons | Creative Commons Attribution[- ]Non-?Commercial[- ]Share-?Alike 3\.0(?: Unported)?
CC-BY-NC-3.0 | title | creative+commons | Creative Commons Attribution[- ]Non-?Commercial 3\.0(?: Unported)?
CC-BY-ND-3.0 | title | creative+commons | Creative Commons Attribution[- ]No-?Derivs? 3\.0(?: Unported)?
CC-BY-SA-3.0 | title | creative+commons | Creative Commons Attribution[- ]Share-?Alike 3\.0(?: Unported)?
CC-BY-3.0 | title | creative+commons | Creative Commons Attribution 3\.0(?: Unported)?
CC-BY-SA-2.5 | title | creative+commons | Creative Commons Attribution[- ]Share-?Alike 2\.5
CC-BY-2.5 | title | creative+commons | Creative Commons Attribution 2\.5
CC-BY-2.0 | title | creative+commons | Creative Commons Attribution 2\.0
CC-BY-NC-ND-4.0 | name | by-nc-nd | \bCC[- ]BY-NC-ND(?:[- ]4\.0)?\b
CC-BY-NC-SA-4.0 | name | by-nc-sa | \bCC[- ]BY-NC-SA(?:[- ]4\.0)?\b
CC-BY-NC-4.0 | name | by-nc | \bCC[- ]BY-NC(?:[- ]4\.0)?\b(?!-)
CC-BY-ND-4.0 | name | by-nd | \bCC[- ]BY-ND(?:[- ]4\.0)?\b
CC-BY-SA-4.0 | name | by-sa | \bCC[- ]BY-SA[- ]4\.0\b
CC-BY-SA-3.0 | name | by-sa | \bCC[- ]BY-SA[- ]3\.0\b
CC-BY-SA-unspecified | name | by-sa | \bCC[- ]BY-SA\b
CC-BY-4.0 | name | 4.0 | \bCC[- ]BY[- ]4\.0\b
CC-BY-3.0 | name | 3.0 | \bCC[- ]BY[- ]3\.0\b
CC-BY-NC-ND-4.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-NC-SA-4.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-4.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-ND-4.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-SA-4.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-4.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by/4\.0/?
CC-BY-SA-3.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-3.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by/3\.0/?
CC-BY-NC-SA-3.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-nc-sa/3\.0/?
CC-BY-NC-3.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by-nc/3\.0/?
CC-BY-2.0 | url | creativecommons.org | https?://creativecommons\.org/licenses/by/2\.0/?
CC-unspecified | title | creative+commons | Creative Commons licen[sc]e
Unlicense | text | unencumbered | This is free and unencumbered software released into the public domain
Unlicense | title | unlicense | \bThe Unlicense\b
Unlicense | url | unlicense.org | https?://(?:www\.)?unlicense\.org/?
WTFPL | title | what+the | DO WHAT THE F(?:UCK|\*CK) YOU WANT TO PUBLIC LICENSE
WTFPL | name | wtfpl | \bWTFPL\b
Zlib | text | as-is+altered | This software is provided 'as-is', without any express or implied warranty\. In no event will the authors? be held liable for any damages arising from the use of this software
Zlib | title | zlib+licen | \bzlib(?:/libpng)? licen[sc]e
BSL-1.0 | notice | boost | Distributed under the Boost Software License,? Version 1\.0
BSL-1.0 | text | boost+permission | Boost Software License - Version 1\.0 - August 17th, 2003
BSL-1.0 | title | boost | Boost Software License(?: 1\.0)?
BSL-1.0 | url | boost.org | https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
BUSL-1.1 | title | business+source | Business Source License(?: 1\.1)?
SSPL-1.0 | title | server+side | Server Side Public License,? (?:Version |v\.? ?)?1
SSPL-1.0 | name | sspl | \bSSPL\b
Elastic-2.0 | title | elastic+licen | Elastic License,? (?:Version |v)?2(?:\.0)?
Artistic-2.0 | title | artistic | (?:The )?Artistic License,? (?:Version |v)?2\.0
Artistic-1.0 | title | artistic | (?:The )?Artistic License,? (?:Version |v)?1\.0
Artistic-unspecified | title | artistic | \bArtistic Licen[sc]e
Artistic-1.0-Perl | notice | perl+terms | under the same terms as Perl itself
PSF-2.0 | title | python+foundation | PYTHON SOFTWARE FOUNDATION LICENSE(?: VERSION 2)?
Python-2.0 | title | python+licen | \bPython License(?:,? Version 2)?
Ruby | title | ruby+licen | \bRuby Licen[sc]e|under the same terms as Ruby
PHP-3.01 | title | php+licen | The PHP License,? version 3\.01?
PHP-3.01 | notice | php+subject | subject to version 3\.01? of the PHP license
OpenSSL | title | openssl | OpenSSL Licen[sc]e
OpenSSL | text | openssl+toolkit | This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
SSLeay | text | cryptographic | This product includes cryptographic software written by Eric Young
OFL-1.1 | notice | open+font | licensed under the SIL Open Font License,? Version 1\.1
OFL-1.1 | title | open+font | SIL Open Font License(?:,? Version 1\.1)?
OFL-1.1 | url | scripts.sil.org | https?://scripts\.sil\.org/OFL
ODbL-1.0 | title | database | Open (?:Data Commons Open )?Database License(?: \(ODbL\))?(?: v(?:ersion|\.)? ?1\.0)?
ODbL-1.0 | url | opendatacommons | https?://(?:www\.)?opendatacommons\.org/licenses/odbl/?(?:1\.0/?)?
ODC-By-1.0 | title | data+commons | Open Data Commons Attribution License(?: v1\.0)?
ODC-By-1.0 | url | opendatacommons | https?://(?:www\.)?opendatacommons\.org/licenses/by/?(?:1[.-]0/?)?
PDDL-1.0 | title | domain+dedication | Public Domain Dedication (?:and|&) License(?: \(PDDL\))?
CDLA-Permissive-2.0 | title | community+data | Community Data License Agreement[ –-]+Permissive[, -]+(?:Version )?2\.0
CDLA-Permissive-1.0 | title | community+data | Community Data License Agreement[ –-]+Permissive[, -]+(?:Version )?1\.0
CDLA-Sharing-1.0 | title | community+data | Community Data License Agreement[ –-]+Sharing[, -]+(?:Version )?1\.0
OGL-UK-3.0 | notice | government+licen | Contains public sector information licensed under the Open Government Licen[sc]e v3\.0
OGL-UK-3.0 | title | government+licen | Open Government Licen[sc]e(?: v(?:ersion)? ?3\.0)?
etalab-2.0 | title | ouverte | Licence Ouverte(?: / Open Licen[sc]e)?(?: (?:version |v)?2\.0)?
DL-DE-BY-2.0 | title | datenlizenz | Datenlizenz Deutschland[ –-]+Namensnennung[ –-]+(?:Version )?2\.0
CECILL-2.1 | title | cecill | \bCeCILL(?:[- ](?:v(?:ersion)? ?)?2\.1)?\b
CECILL-B | title | cecill | \bCeCILL-B\b
CECILL-C | title | cecill | \bCeCILL-C\b
MS-PL | title | microsoft+public | Microsoft Public License(?: \(MS-PL\))?
MS-RL | title | microsoft+reciprocal | Microsoft Reciprocal License(?: \(MS-RL\))?
IPL-1.0 | title | ibm+public | IBM Public License(?: Version 1\.0)?
NCSA | title | illinois | University of Illinois(?:/|/ )?NCSA Open Source License
UPL-1.0 | title | universal+permissive | Universal Permissive License(?: \(UPL\))?,? (?:Version |v)?1\.0
OSL-3.0 | title | open+software | Open Software License,? (?:version |v\.? ?)?3\.0
AFL-3.0 | title | academic+free | Academic Free License,? (?:version |v\.? ?)?3\.0
AFL-2.1 | title | academic+free | Academic Free License,? (?:version |v\.? ?)?2\.1
QPL-1.0 | title | public+licen | \bQ Public License(?: version 1\.0)?
LPPL-1.3c | notice | latex+licen | distributed (?:and/or modified )?under the conditions of the LaTeX Project Public License,? (?:either )?version 1\.3c?
LPPL-unspecified | title | latex+licen | LaTeX Project Public License
SGI-B-2.0 | title | sgi+free | SGI FREE SOFTWARE LICENSE B(?: \(Version 2\.0)?
W3C | title | w3c+licen | W3C(?:\(R\)|®)? SOFTWARE NOTICE AND LICENSE|W3C Software and Document (?:Notice and )?License
Vim | title | vim+licen | \bVIM LICENSE\b
Beerware | text | beer | you can buy me a beer in return
Beerware | title | beer | (?:THE )?BEER-?WARE LICENSE
JSON | text | good+evil | The Software shall be used for Good, not Evil
Sleepycat | title | sleepycat | Sleepycat License
PostgreSQL | title | postgresql+licen | (?:The )?PostgreSQL Licen[sc]e
curl | title | curl+licen | \bcurl licen[sc]e
libpng | title | libpng | \b(?:PNG Reference Library|libpng) License(?: version 2)?
IJG | text | independent+jpeg | This software is based in part on the work of the Independent JPEG Group
FTL | title | freetype | (?:The )?FreeType (?:Project )?LICENSE
Info-ZIP | title | info-zip | \bInfo-ZIP license
bzip2-1.0.6 | title | bzip2+licen | \bbzip2(?: and libbzip2)? License
Unicode-DFS-2016 | title | unicode | UNICODE,? INC\.? LICENSE AGREEMENT
ICU | title | icu+licen | \bICU License
NAIST-2003 | title | nara | Nara Institute of Science and Technology
HPND | title | historical+permission | Historical Permission Notice and Disclaimer
Intel | title | intel+open | Intel Open Source License
NASA-1.3 | title | nasa+open | NASA OPEN SOURCE AGREEMENT VERSION 1\.3
ECL-2.0 | title | educational+community | Educational Community License,? (?:Version |v)?2\.0
MulanPSL-2.0 | title | mulan | Mulan Permissive Software License,? (?:v2|Version 2)
MulanPSL-2.0 | name | mulanpsl | \bMulanPSL-?2\.0\b
RPL-1.5 | title | reciprocal+public | Reciprocal Public License(?: 1\.5)?
CPAL-1.0 | title | common+attribution | Common Public Attribution License(?: Version 1\.0)?
APSL-2.0 | title | apple+public | Apple Public Source License(?:,? Version 2\.0)?
Watcom-1.0 | title | watcom | Sybase Open Watcom Public License
OpenRAIL-M | title | rail | \b(?:BigScience |CreativeML |BigCode )?Open ?RAIL(?:\+\+)?-M(?: License)?
OpenRAIL-unspecified | title | responsible+licen | \bResponsible AI License
Llama-2 | title | llama+community | Llama 2 Community License(?: Agreement)?
Llama-3 | title | llama+community | (?:Meta )?Llama 3(?:\.\d)? Community License(?: Agreement)?
Gemma | title | gemma+terms | Gemma Terms of Use
Commons-Clause | title | commons+clause | "?Commons Clause"? License Condition
PolyForm-Noncommercial-1.0.0 | title | polyform | PolyForm Noncommercial License(?: 1\.0\.0)?
PolyForm-Shield-1.0.0 | title | polyform | PolyForm Shield License(?: 1\.0\.0)?
PolyForm-Small-Business-1.0.0 | title | polyform | PolyForm Small Business License(?: 1\.0\.0)?
Parity-7.0.0 | title | parity+licen | (?:The )?Parity Public License(?: 7\.0\.0)?
BlueOak-1.0.0 | title | blue+oak | Blue Oak Model License(?: 1\.0\.0)?
Hippocratic-2.1 | title | hippocratic | Hippocratic License(?: Version 2\.1)?
EULA | title | end+user | END[- ]USER LICEN[SC]E AGREEMENT
proprietary | notice | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | notice | unauthori+copying | Unauthori[sz]ed copying of this (?:file|document|software|work),? via any medium,? is strictly prohibited
all-rights-reserved | notice | copyright+reserved | (?:Copyright|©|\(c\)) (?:\(c\) |© )?(?:[12]\d{3}(?:[-, –]+[12]\d{3})*,? )?[^\n]{1,80}?[.,]? All rights reserved
all-rights-reserved | name | reserved | \bAll rights reserved\b
all-rights-reserved | name | reservados | \bTodos los derechos reservados\b
all-rights-reserved | name | droits | \bTous droits réservés\b
all-rights-reserved | name | rechte | \bAlle Rechte vorbehalten\b
public-domain | notice | public+domain | (?:released|dedicated|placed|put) (?:in)?to the public domain|is in the public domain
public-domain | name | public+domain | \bpublic domain\b
copyright-notice | name | copyright | \bCopyright (?:\(c\)|©)? ?[12]\d{3}(?:[-, –]+[12]\d{3})*,? [^\n]{1,60}
free-unknown | notice | licen+file | (?:see|refer to) the (?:accompanying |enclosed )?LICEN[SC]E(?:\.txt|\.md)? (?:file )?(?:for|in)
free-unknown | notice | licen+found | Use of this source code is governed by (?:an? )?.{1,40}?licen[sc]e that can be found in the LICENSE file
"""
