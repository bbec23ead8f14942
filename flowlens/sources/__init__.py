"""Readers: flow tables (parquet / csv / json), capture files (pcap / pcapng),
packet-list exports, and the fixture views over the driver's tables."""
