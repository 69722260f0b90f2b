"""tonewright: text-bias annotation over tables and streams of texts, written for Spark."""
