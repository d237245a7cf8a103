"""marlstone.operators"""
