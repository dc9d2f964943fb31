"""notelens: analytics over corpora of semi-structured notes, as Spark plans."""
