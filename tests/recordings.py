"""EDF files and the tables beside them, for tests."""

import numpy as np


def edf_bytes(names, samples, sfreq, records=None, seconds=1.0):
    """An EDF file of int16 samples [channel, n] (physical value = sample / 10); n must fill whole records."""
    per = int(sfreq * seconds)
    x = np.asarray(samples, dtype="<i2")
    n = x.shape[1] // per

    def field(v, width):
        return str(v).ljust(width).encode()

    ns = len(names)
    head = field("0", 8) + field("", 160) + field("", 16) + field(256 * (1 + ns), 8) + field("", 44) + field(n if records is None else records, 8) + field(f"{seconds:g}", 8) + field(ns, 4)
    for value, width in ((None, 16), ("", 80), ("uV", 8), (-100, 8), (100, 8), (-1000, 8), (1000, 8), ("", 80), (per, 8), ("", 32)):
        head += b"".join(field(names[k] if value is None else value, width) for k in range(ns))
    body = x.reshape(ns, n, per).transpose(1, 0, 2).tobytes()
    return head + body


def put_recording(root, subject, run, names, samples, sfreq, statuses=None, described=None, onset=2.0, events=True, channels=True, cut=None):
    """One recording of a BIDS tree: sub-*/ses-*/ieeg/ with its _events.tsv and _channels.tsv."""
    at = root / f"sub-{subject}" / "ses-presurgery" / "ieeg"
    at.mkdir(parents=True, exist_ok=True)
    stem = f"sub-{subject}_ses-presurgery_task-ictal_acq-ecog_run-{run:02d}"
    (at / f"{stem}_ieeg.edf").write_bytes(edf_bytes(names, samples, sfreq)[:cut])
    if events:
        (at / f"{stem}_events.tsv").write_text(f"onset\tduration\ttrial_type\n{onset}\t0\tsz onset\n{(onset or 0) if onset != 'n/a' else 1}\t0\tlater\n")
    if channels:
        # Columns stand in another order in each subject's files.
        cols = ["name", "type", "status", "status_description"] if subject < "b" else ["status_description", "status", "name"]
        rows = [{"name": n, "type": "ECOG", "status": (statuses or ["good"] * len(names))[k], "status_description": (described or ["n/a"] * len(names))[k]} for k, n in enumerate(names)]
        (at / f"{stem}_channels.tsv").write_text("\t".join(cols) + "\r\n" + "".join("\t".join(r[c] for c in cols) + "\r\n" for r in rows))
    return at / f"{stem}_ieeg.edf"
